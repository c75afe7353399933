"""Matching of entities across sources without a shared key: a cascade of exact rules, weaker ones after stronger ones."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.keys import LATIN, LOOKALIKES, file_key, strip
from mensura.functions.names import resolve_variable, variable_names
from mensura.functions.numbers import quantity
from mensura.session import cut, drop
from mensura.sources.tables import spread

#: Labelled records, of lowest key hash, on which a rule's precision is measured.
LABELLED = 2_000
#: Left records of a key from which on its pairs are judged where they are made, and only the two best of a right record are kept.
FREQUENT = 100
#: Left records of a block that one task compares with the right ones; a larger block is compared in pieces.
PIECE = 20_000
#: Labelled precision below which a rule is more often wrong than right.
LEAST = 0.5
#: Lead in shared title words by which one of several candidates is the right one.
MARGIN = 0.15
#: Letters of a word that its keys keep, as abbreviations keep a word's beginning; whole words are compared after the join.
STEM = 4
#: Share of records from which on a word counts as a real word.
USUAL = 0.002
#: Share of records from which on a word is a phrase's, which tells little of what a title is about.
PHRASE = 0.15
#: Letters in which a misread surname differs at most.
MISREAD = 4
#: Words that say nothing about a title, and titles that are none.
STOP = ("the", "and", "for", "with", "from", "that", "their", "its", "during", "before", "after", "under", "into", "made", "high", "etc")
NO_TITLE = ("research paper", "contents lists available online", "original article", "article", "review", "full length article", "short communication", "untitled", "contents lists available at", "research article", "original research")
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.normalize("NFD", c) != c)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), for which value is worked out once, however often of uses it: within a lambda it would be again at each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def is_ascii(text: Column) -> Column:
    """True if a text has no character to translate, which costs far more than to tell."""
    return F.octet_length(text) == F.char_length(text)


def plain(text: Column) -> Column:
    """Lower-case text without accents, ligatures, look-alikes and hyphens at line ends."""


    def of(whole: Column) -> Column:
        t = whole
        for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
            t = F.replace(t, F.lit(a), F.lit(b))
        # look-alikes and accented letters in one go, as no letter is both
        t = F.regexp_replace(F.translate(t, LOOKALIKES + _WIDE + _ACCENTED, LATIN + _NARROW + _PLAIN), "[̀-ͯ]", "")
        return F.lower(F.when(is_ascii(whole), whole).otherwise(t))

    return once(F.regexp_replace(text, "[-­‐]\\s*[\\n\\r]+\\s*", ""), of)


def title_words(title: Column) -> Column:
    """Distinct words of a title, without small words; empty for null and for what is no title."""


    def of(t: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(t, "[^a-z]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
        real = ~F.coalesce(strip(t).isin(*NO_TITLE), F.lit(True))
        return F.when(real, F.array_distinct(words)).otherwise(F.array().cast("array<string>"))

    return once(F.regexp_replace(plain(title), "/w\\b", " in water"), of)


def stems(words: Column) -> Column:
    """Distinct beginnings of words: abbreviations keep a word's beginning, and so do most misreadings."""
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def usual_words(records: Sequence[DataFrame], share: float = USUAL) -> dict[str, float]:
    """Stems that at least a share of all records with words have, with their share: real words, no misreadings.

    As many at most as the mean number of words of a record divided by the share.
    """
    words = functools.reduce(DataFrame.unionByName, [r.select("words") for r in records]).where(F.size("words") > 0)
    counted = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = max(1, words.count())
    return {r.w: r.n / total for r in counted.where(F.col("n") >= max(2, share * total)).orderBy("w").collect()}


def odd_words(full: Column, other_stems: Column, other_full: Column, usual: Column) -> Column:
    """Usual words of one title that the other doesn't have, not even misread (a letter or two off, or letters swapped)."""
    return F.filter(full, _is_odd(other_stems, other_full, usual))


def _is_odd(other_stems: Column, other_full: Column, usual: Column) -> Callable[[Column], Column]:
    """Whether a word is one of odd_words; most aren't, as the other title has their stem, so that is asked first."""
    return (
        lambda x: ~F.array_contains(other_stems, F.substring(x, 1, STEM))
        & F.array_contains(usual, F.substring(x, 1, STEM))
        & ~F.exists(other_full, lambda y: (F.levenshtein(x, y) <= F.when(F.length(x) <= 4, 1).otherwise(2)) | ((F.length(x) == F.length(y)) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))))
    )


def initials(journal: Column) -> Column:
    """Initials of a journal's name up to its first digit, equal for the name and its abbreviation; null if there are fewer than two."""
    t = F.regexp_replace(F.regexp_extract(plain(journal), "^[^0-9]*", 0), "[^a-z]+", " ")
    words = F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin("of", "and", "the", "for", "in", "on", "de", "der"))
    key = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(key) >= 2, key)


def first_author(authors: Column) -> Column:
    """Words of at least three letters of the first author's name from an author line of any usual style.

    The first author ends at a comma, semicolon, dot between blanks, 'and', '&' or 'et al.'.
    """
    t = F.regexp_replace(F.regexp_replace(plain(authors), "(?<=[a-z])0(?=[a-z])", "o"), "[^a-z.,;&·•|-]+", " ")
    first = F.get(F.filter(F.split(t, r"[;,·•|&]|\band\b|\bet\s+al\b|\bund\b"), lambda p: p.rlike("[a-z]{3}")), F.lit(0))
    return F.filter(F.split(F.regexp_replace(first, "[^a-z]+", " "), " "), lambda w: F.length(w) >= 3)


def first_surname(authors: Column) -> Column:
    """The first author's surname, the longest of the name's words (the first of several), or null."""
    return _longest(first_author(authors))


def _longest(words: Column) -> Column:
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(F.length(longest) >= 3, longest)


def years(*texts: Column) -> Column:
    """Distinct years from 1900 to 2099 in the texts."""
    found = F.concat(*[F.coalesce(F.regexp_extract_all(t, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1), F.array().cast("array<string>")) for t in texts])
    return F.array_distinct(F.transform(found, lambda y: y.cast("int")))


def around(years_: Column) -> Column:
    """The years and those beside them."""
    return F.array_distinct(F.flatten(F.transform(years_, lambda y: F.array(y, y - 1, y + 1))))


def year_blocks(years_: Column, beside: int = 0) -> Column:
    """Blocks of four years that hold the years, or a year up to so many beside them: fewer keys than the years, to be checked after."""
    return F.array_distinct(F.flatten(F.transform(years_, lambda y: F.array(F.floor((y - beside) / 4), F.floor((y + beside) / 4)))))


def one_off(name: Column) -> Column:
    """The name and the name without any one letter: two names that differ by one letter, or two neighbours swapped, share one."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))))


def runs(words: Column, places: Sequence[tuple[int, ...]]) -> Column:
    """Hashes of the words at these places after each word (0 is the word itself), in their order: neighbours, and some over a gap."""

    def of(words: Column) -> Column:
        def each(run: tuple[int, ...]) -> Column:
            at = [F.slice(words, F.lit(p + 1), F.greatest(F.size(words) - max(run), F.lit(0))) for p in run]  # the words at each place, all of one length
            return functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)), at)

        return F.when(F.size(words) > 1, F.concat(*[each(run) for run in places])).otherwise(F.array().cast("array<bigint>"))

    return once(words, of)


#: Two neighbouring words, or two with one between; three of four neighbouring words.
TWO, THREE = ((0, 1), (0, 2)), ((0, 1, 2), (0, 1, 3), (0, 2, 3))


@dataclass(frozen=True)
class Rule:
    """An exact join on keys made alike on both sides.

    left, right: keys of a record, an array of hashes; a record agrees with another as often as they share keys. votes: least
    number of shared keys; share: least share of title words among the smaller number of title words.
    never: names of facts, any of which says that a pair can't be one entity by this rule.
    Of the pairs that these leave, the one with clearly the most keys that no other left record has is taken; if none
    has `votes` of those, or if scored, the one whose share of title words is ahead of the second by MARGIN.
    block: (left, right) arrays of hashes, for a rule of several keys that are frequent: all records that share one are compared,
    and left and right are keys within it, so that no key is joined on and none has to be left out for being frequent.
    """

    name: str
    left: Column
    right: Column
    votes: int = 1
    share: float = 0.0
    never: tuple[str, ...] = ()
    scored: bool = False
    block: tuple[Column, Column] | None = None


def same_word(x: Column, y: Column) -> Column:
    """True if two words begin alike and one is the other's beginning (an abbreviation) or a letter or two off."""
    return (F.substring(x, 1, STEM) == F.substring(y, 1, STEM)) & (x.startswith(y) | y.startswith(x) | (F.levenshtein(x, y) <= 2))


def common_share(full: Column, other: Column) -> Column:
    """Share of the words of the title with fewer words that the other title has too."""

    def of(both: Column) -> Column:
        few, many = both["few"], both["many"]
        # most words that the other title has are the same to the letter
        return F.size(F.filter(few, lambda x: F.array_contains(many, x) | F.exists(many, lambda y: same_word(x, y)))) / F.greatest(F.lit(1), F.size(few))

    fewer = F.size(full) <= F.size(other)
    return once(F.struct(F.when(fewer, full).otherwise(other).alias("few"), F.when(fewer, other).otherwise(full).alias("many")), of)


def _by_rule(rules: Mapping[int, Rule], of: Callable[[Rule], object], default: object) -> Column:
    """A value of each pair's rule."""
    return functools.reduce(lambda c, nr: F.when(F.col("_rule") == nr[0], of(nr[1])).otherwise(c), rules.items(), F.lit(default))


def _bits(records: DataFrame) -> Column:
    """A bit for each stem of the title; a column of the records if they have it already."""
    return F.col("_bits") if "_bits" in records.columns else _bits_by(F.xxhash64)


def _bits_by(of: Callable[[Column], Column]) -> Column:
    """A bit for each stem of the title, by a hash of it."""
    return F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(of(w), F.lit(64)).cast("int"))))


def _need(rules: Mapping[int, Rule], bits: str = "_bits") -> Column:
    """Bits in common without which a pair in which this is the title of fewer words can't reach the rule's share (a bit may stand for several words)."""
    # rounded down with a little to spare, as shares are floating point numbers
    return F.floor(F.bit_count(bits) - (1 - _by_rule(rules, lambda r: F.lit(r.share), 0.0)) * F.col("_size") - 1e-6).cast("int") + 1


def _may_share(bits: str = "_bits", need: str = "_need") -> Column:
    """True for every pair (the left record's columns prefixed with l_) whose titles have the rule's share of words in common, and for some others."""
    return F.bit_count(F.col(bits).bitwiseAND(F.col(f"l_{bits}"))) >= F.when(F.col("_size") <= F.col("l__size"), F.col(need)).otherwise(F.col(f"l_{need}"))


def _keyed(records: DataFrame, id_: str, side: str, rules: Mapping[int, Rule]) -> DataFrame:
    """(id, _rule, _key, _bits, _size, _need, _alike): the keys of several rules, hashed with the rule's number; _size: words of the title."""

    # a row per rule, then one per key, so that the hashing of keys is compiled, which it isn't within a lambda
    each = F.array(*[F.struct(F.lit(n).alias("r"), F.array_distinct(getattr(r, side)).alias("k")) for n, r in rules.items()])
    each = each if rules else each.cast("array<struct<r: int, k: array<bigint>>>")
    alike = F.col("_alike") if "_alike" in records.columns else F.lit(1)
    rows = records.select(id_, _bits(records).alias("_bits"), F.size("full").alias("_size"), alike.cast("bigint").alias("_alike"), F.explode(each).alias("_k"))
    rows = rows.select(id_, F.col("_k.r").alias("_rule"), "_bits", "_size", "_alike", F.explode_outer("_k.k").alias("_k")).where("_k is not null")
    return rows.select(id_, "_rule", F.xxhash64("_k", "_rule").alias("_key"), "_bits", "_size", "_alike").withColumn("_need", _need(rules))


def _judged(pairs: DataFrame, rules: Mapping[int, Rule], facts: Mapping[str, Column]) -> DataFrame:
    """The pairs (with the columns of both records, those of the left prefixed with l_) that the rules' shares and vetoes leave, with _share."""
    least = _by_rule(rules, lambda r: F.lit(r.share), 0.0)
    # words are alike only if their stems are equal: most pairs are told apart by the stems; a stem may stand for several words
    few = F.size("full") <= F.size("l_full")
    words, stems_ = F.when(few, F.size("full")).otherwise(F.size("l_full")), F.when(few, F.size("words")).otherwise(F.size("l_words"))
    some = F.size(F.array_intersect("words", "l_words")) + words - stems_ + 1e-6 >= least * words
    # the row number keeps the planner from asking for the share below, where it would be worked out a second time
    full = pairs.where(some).withColumns({"_share": common_share(F.col("full"), F.col("l_full")), "_nr": F.monotonically_increasing_id()}).where((F.col("_share") >= least) & (F.col("_nr") >= 0)).drop("_nr")
    return _allowed(full, rules, facts)


def _allowed(pairs: DataFrame, rules: Mapping[int, Rule], facts: Mapping[str, Column]) -> DataFrame:
    """The pairs that the rules' vetoes leave."""
    used = {n for r in rules.values() for n in r.never}
    full = pairs.withColumns({f"_is_{n}": F.coalesce(c, F.lit(False)) for n, c in facts.items() if n in used})
    return full.where(~_by_rule(rules, lambda r: functools.reduce(lambda a, n: a | F.col(f"_is_{n}"), [n for n in r.never if n in facts], F.lit(False)), False))


def _named(left: DataFrame, left_id: str) -> DataFrame:
    return left.select(*[F.col(c).alias(c if c == left_id else f"l_{c}") for c in left.columns])


def _best_of_hot(mine: DataFrame, theirs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Mapping[int, Rule], facts: Mapping[str, Column]) -> DataFrame:
    """(right_id, left_id, _rule): of all pairs of these keys that a rule leaves, the two of the largest share of each right record.

    The others can't change a decision: votes come from keys of one left record, and by shares the first needs a lead over the
    second. The pairs are judged where the join makes them and none is written; that costs time, a pair each, but no disk.
    """
    made = theirs.select(right_id, "_key").join(right, right_id).join(mine.select(left_id, "_key", "_rule").join(_named(left, left_id), left_id), "_key")
    pairs = _judged(made, rules, facts).select(right_id, left_id, "_rule", "_share")
    top = lambda df: df.groupBy(right_id, "_rule").agg(F.max(F.struct("_share", left_id)).alias("_f")).select(right_id, "_rule", F.col(f"_f.{left_id}").alias(left_id))
    first = cut(top(pairs))
    beaten = pairs.join(first.select(right_id, "_rule", F.col(left_id).alias("_first")), [right_id, "_rule"]).where(F.col(left_id) != F.col("_first"))
    return first.unionByName(top(beaten))


def _candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Mapping[int, Rule], frequent: int, facts: Mapping[str, Column] | None = None) -> DataFrame:
    """(right_id, left_id, _rule, _shared, _votes): pairs that share keys, with the number of keys, and of those no other left record has.

    All pairs are made, however frequent their keys; the join itself leaves out those whose titles can't have the rule's share of words
    in common, so that few are written. For rules that ask for one key, a key of more than `frequent` left records gives each right
    record's two best pairs that the vetoes in facts leave, which decide as all of them would.
    """
    facts = facts or {}
    one = {n: r for n, r in rules.items() if r.votes == 1}
    # written once, as making keys costs more than reading them
    single = cut(_keyed(left, left_id, "left", one))
    several = {n: r for n, r in rules.items() if n not in one}
    mine, theirs = single.unionByName(_keyed(left, left_id, "left", several)) if several else single, _keyed(right, right_id, "right", rules)
    hot = cut(single.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > frequent).select("_key"))
    some = not hot.isEmpty()
    cold = lambda k: k.join(hot, "_key", "left_anti") if some else k
    owned = cold(mine).withColumn("_n", F.sum("_alike").over(Window.partitionBy("_key")))
    owned = owned.select(left_id, "_rule", F.col("_key").alias("l_key"), F.col("_bits").alias("l__bits"), F.col("_size").alias("l__size"), F.col("_need").alias("l__need"), (F.col("_n") == 1).alias("_alone"))
    pairs = cold(theirs).select(right_id, "_key", "_bits", "_size", "_need").join(owned, (F.col("_key") == F.col("l_key")) & _may_share()).select(right_id, left_id, "_rule", "_alone")
    if some:
        only = lambda k: k.join(hot, "_key", "left_semi")
        pairs = pairs.unionByName(_best_of_hot(only(mine), only(theirs), left, right, left_id, right_id, rules, facts).withColumn("_alone", F.lit(False)))
    return pairs.groupBy(right_id, left_id, "_rule").agg(F.count("*").alias("_shared"), F.count_if("_alone").alias("_votes"))


def _in_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Mapping[int, Rule], facts: Mapping[str, Column]) -> DataFrame:
    """(right_id, left_id, _rule, _votes, _share, _twin): the pairs that rules with blocks leave.

    The records go to their blocks whole and are compared there, first by their titles' bits and stems, so that a pair is written
    only if it has the rule's keys and share and no veto. That costs time, a comparison of bits each, but no disk.
    """

    def rows(records: DataFrame, id_: str, side: str) -> DataFrame:
        given = [c for c in records.columns if c != "_bits"]
        each = F.array(*[F.struct(F.lit(n).alias("r"), F.array_distinct(r.block[side == "right"]).alias("b"), F.array_distinct(getattr(r, side)).alias("k")) for n, r in rules.items()])
        made = {"_bits": _bits(records), "_bits2": _bits_by(lambda w: F.xxhash64(w, F.lit(1))), "_size": F.size("full")}
        own = records.select(*given, *[c.alias(n) for n, c in made.items()], F.explode(each).alias("_k")).select(*given, *made, F.col("_k.r").alias("_rule"), F.col("_k.k").alias("_keys"), F.col("_k.b").alias("_b"))
        own = own.where(F.size("_keys") >= _by_rule(rules, lambda r: r.votes, 1)).withColumns({"_need": _need(rules), "_need2": _need(rules, "_bits2")})
        return own.select("*", F.explode("_b").alias("_block")).drop("_b").withColumn("_block", F.xxhash64("_block", "_rule"))

    mine, theirs = cut(rows(left, left_id, "left")), rows(right, right_id, "right")
    alone = mine.select(left_id, "_alike", "_block", F.explode("_keys").alias("_key")).groupBy("_block", "_key").agg(F.sum("_alike").alias("_n"), F.min(left_id).alias(left_id)).where("_n = 1").groupBy(left_id, "_block").agg(F.collect_list("_key").alias("_alone"))
    mine, theirs, many = mine.join(alone, [left_id, "_block"], "left"), theirs.withColumn("_piece", F.lit(0)), cut(mine.groupBy("_block").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces")).where("_pieces > 1"))
    if many.isEmpty():
        mine = mine.withColumn("_piece", F.lit(0))
    else:
        mine = mine.join(many, "_block", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(left_id), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")
        theirs = theirs.join(many, "_block", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    shared = lambda keys: F.size(F.array_intersect("_keys", keys))
    # the cheapest first; no filter after the one of row numbers, which is always true, goes into the join, whose code is compiled only
    # without them and which would ask them of every pair (of rand() >= 0 the planner knows that it is true, and leaves it out)
    pairs = theirs.join(_named(mine, left_id), (F.col("_block") == F.col("l__block")) & (F.col("_piece") == F.col("l__piece")) & _may_share() & _may_share("_bits2", "_need2")).where(F.monotonically_increasing_id() >= 0)
    # keys are compared by compiled code too, and only the pairs that have enough of them are made as rows for what isn't compiled
    pairs = pairs.where((shared("l__keys") >= _by_rule(rules, lambda r: r.votes, 1)) & (F.monotonically_increasing_id() >= 0))
    pairs = _allowed(pairs, {n: replace(r, never=r.never[:1]) for n, r in rules.items()}, facts)
    votes = F.coalesce(F.when(F.col("l__alone").isNotNull(), shared("l__alone")), F.lit(0)).cast("bigint")
    kept = _judged(pairs, rules, facts).select(right_id, left_id, "_rule", votes.alias("_votes"), "_share", (F.col("l__alike") > 1).alias("_twin"))
    return kept.groupBy(right_id, left_id, "_rule").agg(F.max("_votes").alias("_votes"), F.max("_share").alias("_share"), F.max("_twin").alias("_twin"))  # once, in however many blocks it is


def _hits(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Mapping[int, Rule], facts: Mapping[str, Column], frequent: int) -> DataFrame:
    """(right_id, left_id, _rule): each rule's decision for each right record for which it has one.

    A left record that stands for several (_alike) ties with itself: it decides nothing, but others must be ahead of it.
    """
    blocked = {n: r for n, r in rules.items() if r.block is not None}
    joined = {n: r for n, r in rules.items() if n not in blocked}
    found = [_in_blocks(left, right, left_id, right_id, blocked, facts)] if blocked else []
    if joined:
        pairs = _candidates(left, right, left_id, right_id, joined, frequent, facts).where(F.col("_shared") >= _by_rule(joined, lambda r: F.lit(r.votes), 1))
        full = _judged(pairs.join(right, right_id).join(_named(left, left_id), left_id), joined, facts)
        found.append(full.select(right_id, left_id, "_rule", "_votes", "_share", (F.col("l__alike") > 1).alias("_twin")))
    each = Window.partitionBy(right_id, "_rule")
    kept = functools.reduce(DataFrame.unionByName, found).repartition(right_id)
    kept = kept.withColumn("_by_share", F.row_number().over(each.orderBy(F.desc("_share"), left_id))).withColumn("_by_votes", F.row_number().over(each.orderBy(F.desc("_votes"), left_id)))
    at = lambda place, x: F.max(F.when(place, x))
    top = kept.where("_by_share <= 2 or _by_votes <= 2").groupBy(right_id, "_rule").agg(
        at(F.col("_by_votes") == 1, F.struct("_votes", left_id)).alias("_v"), at(F.col("_by_votes") == 2, F.col("_votes")).alias("_v2"),
        at(F.col("_by_share") == 1, F.struct("_share", left_id, "_twin")).alias("_s"), at(F.col("_by_share") == 2, F.col("_share")).alias("_s2"),
    )
    by_votes = ~_by_rule(rules, lambda r: F.lit(r.scored), False) & (F.col("_v._votes") >= _by_rule(rules, lambda r: F.lit(r.votes), 1)) & (F.col("_v._votes") > F.coalesce("_v2", F.lit(0)))
    by_share = ~F.col("_s._twin") & (F.col("_s2").isNull() | (F.col("_s._share") >= F.col("_s2") + MARGIN))
    return top.select(right_id, F.when(by_votes, F.col(f"_v.{left_id}")).when(by_share, F.col(f"_s.{left_id}")).alias(left_id), "_rule").where(F.col(left_id).isNotNull())


def _classes(records: DataFrame, id_: str, number: str) -> tuple[DataFrame, DataFrame]:
    """(records, names): records that are equal in all but their id as one with a number and how many they are (_alike), and (number, id)."""
    attributes = [c for c in records.columns if c != id_]
    text = F.to_json(F.struct(*attributes))
    attributes.append("_bits")  # made once for all passes
    rows = cut(records.where(F.col(id_).isNotNull()).select("*", _bits(records).alias("_bits"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), F.monotonically_increasing_id().alias("_n")))
    same = cut(rows.groupBy("_a", "_b").agg(F.count("*").alias("_alike"), F.min("_n").alias("_first")).where("_alike > 1"))
    if same.isEmpty():
        return rows.select(*attributes, F.lit(1).cast("bigint").alias("_alike"), F.col("_n").alias(number)), rows.select(F.col("_n").alias(number), id_)
    of = rows.join(same, ["_a", "_b"], "left")
    one = cut(of.where("_first is null or _first = _n").select(*attributes, F.coalesce("_alike", F.lit(1)).alias("_alike"), F.col("_n").alias(number)))
    names = cut(of.select(F.coalesce("_first", "_n").alias(number), id_))
    drop(rows, same)
    return one, names


def link(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: Sequence[Sequence[Rule]], facts: Mapping[str, Column] | None = None,
    labels: DataFrame | None = None, labelled: int = LABELLED, frequent: int = FREQUENT, least: float = LEAST,
) -> DataFrame:
    """(left_id, right_id, rule, confidence): the left record of each right record, by the first rule that has one.

    left and right have one row per record, with array columns `words` (stems of the title) and `full` (its words) and a
    column `journal`. passes: the rules, strongest first, in groups that one exact join serves; each pass joins the right
    records that are still open with the left records on its rules' keys and takes those it decides off (anti-join); the
    left records stay, as one may have several right records. A right record has one left record at most; those that
    no rule decides are left out. facts: name -> condition on a pair (columns of the left record prefixed with l_);
    unknown counts as false.

    confidence: the rule's precision on labelled records, (right + 1) / (all + 2). labels has (left_id, right_id) of
    known pairs; without it the pairs of the first rule serve as labels for the others, and the second rule's
    agreeing with them for the first. At most `labelled` labelled records (those of lowest key hash) are asked again
    by every rule; this bounds the measuring, not the linking. A rule that met labels and whose confidence is below
    `least` links nothing; its records are left to the rules after it.

    Null ids are dropped; null attributes give no keys; repeated rows of a record must be put together before.
    Records that are equal in all but their id are judged once: equal left records tie, so none of them is linked, and equal right
    records are decided alike. Empty tables give an empty result.
    """
    # the joins take the records' numbers in the written tables, which are exact and short
    (left, left_names), (right, right_names), names = _classes(left, left_id, "_l"), _classes(right, right_id, "_r"), (left_id, right_id)
    if labels is not None:
        labels = labels.join(left_names, left_id).join(right_names, right_id).withColumn("_weight", F.lit(1).cast("bigint"))
    left_id, right_id = "_l", "_r"
    rules = [r for p in passes for r in p]
    if unknown := {n for r in rules for n in r.never} - set(facts or {}):
        raise ValueError(f"no facts of the names {sorted(unknown)}")
    sample = lambda df: cut(df.orderBy(F.xxhash64(right_id), right_id).limit(labelled).select(right_id, F.col(left_id).alias("_true"), "_weight"))
    known, found, first = sample(labels) if labels is not None else None, None, 0
    for group in passes:
        rest = right if found is None else right.join(found.select(right_id), right_id, "left_anti")
        if found is not None and known is not None:  # labelled records are asked by every rule
            rest = rest.unionByName(right.join(found.select(right_id).distinct().join(known.select(right_id).distinct(), right_id), right_id, "left_semi"))
        open_ = cut(rest) if found is not None else None
        hits = _hits(left, right if open_ is None else open_, left_id, right_id, dict(enumerate(group, first)), facts or {}, frequent)
        before, found = found, cut(hits if found is None else found.unionByName(hits))  # narrow rows; one table keeps each pass's plan short
        del hits
        drop(open_, before)
        if known is None:
            known = sample(found.where("_rule = 0").join(right.select(right_id, F.col("_alike").alias("_weight")), right_id))
        first += len(group)
    met = {r._rule: r for r in found.join(known, right_id).groupBy("_rule").agg(F.sum("_weight").alias("n"), F.coalesce(F.sum(F.when(F.col(left_id) == F.col("_true"), F.col("_weight"))), F.lit(0)).alias("y")).collect()}
    precision = {k: (met[k].y + 1) / (met[k].n + 2) if k in met else 0.5 for k in range(len(rules))}
    if labels is None and len(rules) > 1:  # the first rule made the labels; what the second says of them is its measure
        precision[0] = precision[1]
    poor = [k for k in met if precision[k] < least and k > 0]
    best = found.where(~F.col("_rule").isin(*poor)).groupBy(right_id).agg(F.min(F.struct("_rule", left_id)).alias("_f")).select(F.col(f"_f.{left_id}").alias(left_id), right_id, F.col("_f._rule").alias("_rule"))
    return best.join(left_names, left_id).join(right_names, right_id).select(*names, F.get(F.lit([r.name for r in rules]), F.col("_rule")).alias("rule"), F.get(F.lit([precision[k] for k in range(len(rules))]), F.col("_rule")).alias("confidence"))


# --- studies and papers ------------------------------------------------------------------------------------------


#: Measured values that both sides may give: name -> (columns of a study's rows, variable of a paper's rows).
VALUES = {
    "fat": (("fat_concentration_pct",), "Fat_concentration_wt%"), "d90": (("d90_um",), "d90_µm"), "thickness": (("mean_thickness_10",), "Sensory_thickness"), "creaminess": (("mean_creaminess_10",), "Sensory_creaminess"),
    "temperature": (("sample_preparation_temperature_c", "viscosity_measurement_temperature_c"), "Temperature_C"),
}
#: Gaps of the logarithms of median values: farther apart than most of one publication, and as near as few of two are.
FAR, NEAR = 0.8, 0.25


def _middle(value: Column) -> Column:
    """Logarithm of the median of positive values, by a mergeable sketch, so that a hot record is reduced in every task."""
    return F.log(F.percentile_approx(F.when((value > 0) & ~F.isnan(value), value), 0.5, 1000))


def studies(example_data: DataFrame) -> DataFrame:
    """A record per study: id, surname, year, words of its longest title, journal and measured values, from all of its rows.

    Columns of measured values that the table doesn't have count as null.
    """
    value = lambda cs: F.coalesce(*[F.col(c).cast("double") if c in example_data.columns else F.lit(None).cast("double") for c in cs])
    rows = example_data.select(
        strip(F.col("study_id")).alias("study_id"), F.struct(F.length("title_short").alias("n"), F.col("title_short").alias("t")).alias("title"), "journal", *[value(cs).alias(f"_{v}") for v, (cs, _) in VALUES.items()]
    ).where("study_id <> ''")
    one = rows.groupBy("study_id").agg(F.max("title").alias("title"), F.max("journal").alias("journal"), F.struct(*[_middle(F.col(f"_{v}")).alias(v) for v in VALUES]).alias("values"))
    name = plain(F.col("study_id"))
    return one.withColumn("full", title_words(F.col("title.t"))).select(
        "study_id", F.regexp_replace(F.regexp_extract(name, r"^[^0-9]+", 0), "[^a-z]+", "").alias("surname"), F.array_compact(F.array(F.nullif(F.regexp_extract(name, r"((?:19|20)\d\d)", 1), F.lit("")).cast("int"))).alias("years"),
        "full", stems(F.col("full")).alias("words"), initials(F.col("journal")).alias("journal"), "values",
    )


def paper_values(rows: DataFrame, guide: DataFrame) -> DataFrame:
    """(paper_key, values): medians of the papers' measured values, from every row of the extraction table."""
    wanted = {v: n for n, (_, v) in VALUES.items()}
    names = {k: wanted[v] for k, v in variable_names(guide).items() if v in wanted}
    rows = spread(rows.select("paper", "normalized_variable", "value")).where("paper is not null")
    low = rows.select("paper", "value", resolve_variable(F.col("normalized_variable"), names).alias("_v"), F.monotonically_increasing_id().alias("_nr")).where("_v is not null and _nr >= 0")  # by row number, else _v is made twice
    each = low.select(F.xxhash64(file_key(F.col("paper"))).alias("paper_key"), "_v", quantity(F.lower(strip(F.col("value")))).alias("_x"))
    return each.groupBy("paper_key").agg(F.struct(*[_middle(F.when(F.col("_v") == v, F.col("_x"))).alias(v) for v in VALUES]).alias("values"))


#: Papers of one file name series that must print a year before the series tells it.
SERIES = 5


def papers(headers: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """A record per paper: first author's surname (with and without a footnote letter), years, title words, journal, and
    measured values (those of paper_values, if given).

    A file name of words tells of the title as well; one in the publishers' item identifier form tells the year. Other
    file names that begin with a series and a number ('abc-12-...') tell the year that most papers of that number
    print, if it is the year of at least half of them.
    """
    stem = F.col("paper")
    spelled = title_words(F.regexp_replace(F.regexp_replace(stem, r"-[0-9]+(-v\d+)?$", ""), "-", " "))
    named = F.when(F.size("_spelled") >= 4, F.slice("_spelled", F.lit(1), F.size("_spelled") - 1)).otherwise(F.array().cast("array<string>"))
    item = F.regexp_extract(stem, r"(?i)^1-s2\.0-S\d{7}[\dX](\d\d)\d{6}", 1)
    item_year = F.when(item != "", F.when(item.try_cast("int") >= 60, item.try_cast("int") + 1900).otherwise(item.try_cast("int") + 2000))
    series = F.regexp_extract(stem, r"(?i)^([a-z]+\d*-\d{2,3})-", 1)
    surname = _longest(F.col("_first"))
    bare = F.when(F.col("_surname").rlike("[a-e]$") & (F.length("_surname") > 4), F.left("_surname", F.length("_surname") - 1))
    other = F.get("_first", F.lit(0))  # where the end of the name was misread
    one = headers.where("paper is not null").groupBy("paper").agg(*[F.max(c).alias(c) for c in ("title_line", "author_line", "journal_line", "year_line")]).withColumn("_first", first_author(F.col("author_line"))).withColumns({"_surname": surname, "_spelled": spelled}).select(
        "paper", F.array_distinct(F.array_compact(F.array("_surname", bare, other))).alias("names"), years(F.col("year_line"), F.col("journal_line")).alias("printed"), F.array_compact(F.array(item_year)).alias("item"),
        title_words(F.col("title_line")).alias("titled"), named.alias("named"), initials(F.col("journal_line")).alias("journal"), F.when(series != "", series).alias("series"),
    )
    seen = one.where(F.col("series").isNotNull() & (F.size("printed") == 1)).groupBy("series", F.col("printed")[0].alias("year")).agg(F.count("*").alias("n"))
    told = seen.groupBy("series").agg(F.max(F.struct("n", "year")).alias("top"), F.sum("n").alias("all")).where((F.col("all") >= SERIES) & (F.col("top.n") * 2 >= F.col("all")))
    kind = "struct<" + ", ".join(f"{v}: double" for v in VALUES) + ">"
    if measured is None:
        one = one.withColumn("values", F.lit(None).cast(kind))
    else:
        one = one.withColumn("paper_key", F.xxhash64(file_key(F.col("paper")))).join(measured, "paper_key", "left")
    return one.join(told.select("series", F.col("top.year").alias("told")), "series", "left").select(
        "paper", "names", "values", F.array_distinct(F.concat("printed", "item", F.array_compact(F.array("told")))).alias("years"), F.array_distinct(F.concat("titled", "named")).alias("full"), stems(F.concat("titled", "named")).alias("words"), "journal",
    )


def _keys(*parts: Column) -> Column:
    """A hash of every combination of one element of each part (an array each)."""
    def times(first: Column, second: Column) -> Column:
        return once(second, lambda s: F.flatten(F.transform(first, lambda a: F.transform(s, lambda b: F.xxhash64(a, b)))))

    out = parts[0]
    for part in parts[1:]:
        out = times(out, part)
    return out


def study_facts(usual: Sequence[str] = ()) -> dict[str, Column]:
    """What can be said of a pair of a study and a paper: other authors (further apart than misread names are), other years, other journals, other titles (each has a usual word of the list
    that the other lacks), too few title words, fewer than two in common, values far apart, and values that don't show agreement."""
    full, other = F.col("full"), F.col("l_full")
    known = F.lit(list(usual)) if usual else F.array().cast("array<string>")
    few = (F.size("words") < 2) | (F.size("l_words") < 2)
    odd = F.exists(full, _is_odd(F.col("l_words"), other, known)) & F.exists(other, _is_odd(F.col("words"), full, known))
    gaps = F.array_compact(F.array(*[F.abs(F.col(f"values.{v}") - F.col(f"l_values.{v}")) for v in VALUES]))
    return {
        "other_author": (F.size("names") > 0) & (F.col("l_surname") != "") & ~F.exists("names", lambda n: F.levenshtein(n, F.col("l_surname"), MISREAD) >= 0),
        "other_year": ~F.exists("years", lambda y: F.exists("l_years", lambda z: F.abs(y - z) <= 1)),
        "other_journal": F.col("journal") != F.col("l_journal"), "other_title": ~few & odd, "untitled": few, "one_word": F.size(F.array_intersect("words", "l_words")) < 2,
        "other_values": F.array_max(gaps) > FAR, "unlike_values": (F.size(gaps) < 2) | (F.array_max(gaps) > NEAR),
    }


def study_rules(usual: Mapping[str, float] | None = None) -> list[list[Rule]]:
    """The cascade for studies and papers, strongest first, in four passes of exact joins.

    Author, year and title; then misread authors, titles without an author, and authors of other years; then journals and
    measured values, where the title doesn't tell. Rules but the first are off for pairs whose journals or titles differ; those that
    take no title words also for pairs whose measured values are far apart. Words that usual gives as a phrase's make no runs in
    the second pass, as few of them tell what a title is about; papers that are still open after the third are compared by the runs
    of all words.
    """
    col = F.col
    name, names, year, words, journal = F.array(col("surname")), col("names"), col("years"), col("words"), F.array_compact(F.array(col("journal")))
    none = F.array().cast("array<string>")
    whole = F.when(F.size(words) >= 4, F.array(F.array_join(F.array_sort(words), "+"))).otherwise(none)
    without_title = F.when(F.size(words) < 2, name).otherwise(none)
    telling = F.array_except(words, F.lit([w for w, share in (usual or {}).items() if share >= PHRASE]).cast("array<string>"))
    longest = F.filter(names, lambda n: ~F.exists(names, lambda m: (m != n) & m.startswith(n)))  # a name without its end is among the variants of the whole one
    off, near, variants = F.array_distinct(F.flatten(F.transform(longest, one_off))), around(year), one_off(col("surname"))
    differ = ("other_journal", "other_title")
    weak = ("other_values", *differ)
    return [
        [
            Rule("author, year and whole title", _keys(name, year, whole), _keys(names, year, whole), never=("other_journal",)),
            Rule("author, year and title words", _keys(name, year), _keys(names, year), share=0.5, never=("one_word", *differ), scored=True),
            Rule("author, near year and title words", _keys(name, year), _keys(names, near), share=0.5, never=("one_word", *differ), scored=True),
        ],
        [
            Rule("author and runs of title words", _keys(name, runs(words, ((0, 1),))), _keys(names, runs(words, ((0, 1),))), votes=2, share=0.6, never=differ),
            Rule("nearly the author, near year and title words", _keys(variants, year_blocks(year)), _keys(off, year_blocks(year, 1)), share=0.5, never=("other_year", "one_word", *differ), scored=True),
            Rule("near year, journal and whole title", _keys(year, journal, whole), _keys(near, journal, whole), never=("other_author",)),
            Rule("near year and whole title", _keys(year, whole), _keys(near, whole), never=("other_author", *differ)),
            Rule("near year, journal and runs of title words", _keys(year, journal, runs(telling, TWO)), _keys(near, journal, runs(telling, TWO)), votes=2, share=0.7, never=("other_author", *differ)),
            Rule("near year and runs of title words", _keys(year, runs(telling, THREE)), _keys(near, runs(telling, THREE)), votes=2, share=0.7, never=("other_author", *differ)),
        ],
        [
            Rule("author, near year and more of the title than others", _keys(name, year), _keys(names, near), share=0.5, never=("untitled", *differ), scored=True),
            Rule("author, year and journal", _keys(name, year, journal), _keys(names, year, journal), never=weak),
            Rule("author, near year and journal", _keys(name, year, journal), _keys(names, near, journal), never=weak),
            Rule("author and year", _keys(name, year), _keys(names, year), never=weak),
            Rule("author, near year and measured values", _keys(name, year), _keys(names, near), never=("unlike_values", *differ), scored=True),
            Rule("author and year of a study without a title", _keys(without_title, year), _keys(names, year), never=weak),
            Rule("author and year, the only one that nothing speaks against", _keys(name, year), _keys(names, year), never=weak, scored=True),
            Rule("author and near year, the only one that nothing speaks against", _keys(name, year), _keys(names, near), never=weak, scored=True),
            Rule("nearly the author, near year and journal", _keys(variants, year_blocks(year), journal), _keys(off, year_blocks(year, 1), journal), never=("other_year", *weak)),
        ],
        [
            Rule("near year, journal and runs of any title words", runs(words, TWO), runs(words, TWO), votes=2, share=0.7, never=("other_author", *differ), block=(_keys(year, journal), _keys(near, journal))),
            Rule("near year and runs of any title words", runs(words, THREE), runs(words, THREE), votes=2, share=0.7, never=("other_author", *differ), block=(year, near)),
        ],
    ]
