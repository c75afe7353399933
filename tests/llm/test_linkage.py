import dataclasses

import pytest
from pyspark.sql import functions as F

from mensura.llm import linkage
from mensura.llm.linkage import common_share, first_surname, initials, link, paper_values, papers, studies, study_facts, study_rules, title_words, usual_words


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("D. Takomekuk1 · M. Tobosigok*", "takomekuk"), ("Megasogun, C.F.; Virinanun, A.J.", "megasogun"), ("Négavavan ét al.", "negavavan"), ("KILEVOKOK T and FADAVIKEK P", "kilevokok"), ("J. Lagifovak, A. Ninemaren", "lagifovak"),
        ("Gelokiken, .P.; Kebotavon, M.R.", "gelokiken"), ("L.Vatilagen1", "vatilagen"), ("Litov0vok et al.", "litovovok"), ("FOGOLEGON M", "fogolegon"), (None, None), ("", None), ("A. B.", None),
    ],
)
def test_first_surname(spark, line, name):
    assert one(spark, first_surname, line) == name


def test_keys(spark):
    assert one(spark, initials, "Archives of Oral Processing") == one(spark, initials, "arch. oral proc.") == one(spark, initials, "Arch. Oral Proc. 45 (2009) 721") == "aop"
    assert one(spark, initials, None) is None and one(spark, initials, "17") is None
    assert one(spark, title_words, "Emul-\nsions of oil/w and the WATER") == ["emulsions", "oil", "water"]
    assert one(spark, title_words, "Research paper") == [] and one(spark, title_words, None) == []


STUDIES = [
    (" Alvarok2010 ", "Effect of pectin and soy protein on creaminess of corn oil emulsions", "Dairy Fat Rep.", "corn oil"), ("Alvarok2010", None, None, None),
    ("Alvarok2010b", "Effect of inulin and whey protein on viscosity of olive oil emulsions", None, None),
    ("Berudan2015", None, "Food Texture Letters", None), ("Cemolik2012", "Gellan as a texturiser for milk fat emulsions: creaming and mouthfeel", None, None),
    (None, "x", "y", None), ("Dorun2001", "Relating viscosity to mouthfeel in gelatin emulsions", "Colloid Kitchen Science", None),
]
PAPERS = [
    ("p1", "EFFECT OF PECTIN AND SOY PROTEIN ON CREAMINESS OF CORN OIL EMULSIONS", "J. Alvarok1 · B. Other", "Dairy and Fat Reports", "2010"),
    ("p2", "Effect of inulin and whey protein on viscosity of olive oil emulsi0ns", "ALVAROK J and OTHER B", None, "Accepted 3 May 2011"),
    ("p3", "Influence of something", "Berudan, A.", "Food Text. Lett. 3 (2015) 17", None),
    ("p4", "Gellan as a texturiser for milk fat emulsions: creaming and mouthfeel", None, None, "2012"),
    ("p5", "Relating viscosity to mouthfeel in gelatin emulsions", "A. Dorun", "Dairy Fat Rep.", "2001"),
    ("p6", None, None, None, None), (None, "x", "y", "z", "2010"),
]


def frames(spark, s=STUDIES, p=PAPERS):
    a = studies(spark.createDataFrame(s, "study_id string, title_short string, journal string, oil_type string"))
    b = papers(spark.createDataFrame(p, "paper string, title_line string, author_line string, journal_line string, year_line string"))
    return a, b


def linked(spark, s=STUDIES, p=PAPERS, rules=None, **kw):
    a, b = frames(spark, s, p)
    usual = usual_words([a, b])
    passes = study_rules()
    if rules is not None:
        passes = [[r for group in passes for r in group if r.name in rules]]
    return link(a, b, "study_id", "paper", passes, study_facts(list(usual)), **kw).collect()


def test_cascade(spark):
    got = {r.paper: r for r in linked(spark)}
    assert {p: r.study_id for p, r in got.items()} == {"p1": "Alvarok2010", "p2": "Alvarok2010b", "p3": "Berudan2015", "p4": "Cemolik2012"}
    assert all(0 < r.confidence < 1 for r in got.values()) and got["p1"].rule == "author, year and whole title"


def test_labels_give_confidence(spark):
    labels = spark.createDataFrame([("Alvarok2010", "p1"), ("Berudan2015", "p4")], "study_id string, paper string")
    got = {r.paper: r.confidence for r in linked(spark, rules=("author, year and whole title", "author, near year and title words"), labels=labels)}
    assert got["p1"] == pytest.approx((1 + 1) / (1 + 2))


def test_a_rule_that_fails_on_labels_links_nothing(spark):
    names = ("author, year and whole title", "author, near year and title words")
    assert {r.paper for r in linked(spark, rules=names)} == {"p1", "p2"}
    labels = spark.createDataFrame([("Berudan2015", "p2")], "study_id string, paper string")
    assert {r.paper for r in linked(spark, rules=names, labels=labels)} == {"p1"}


def test_empty_tables(spark):
    for s, p in (([], PAPERS), (STUDIES, []), ([], [])):
        assert linked(spark, s, p) == []


def test_hot_keys_make_no_pairs(spark):
    """Hundreds of studies and papers of one author and year, none with a title but one: only what titles tell apart is linked."""
    s = [(f"Hotun2020{'' if i == 0 else chr(97 + i % 26)}x{i}", None, None, None) for i in range(300)] + [("Hotun2020", "Effect of alginate and oat protein on lubrication of soy oil emulsions", None, None)]
    p = [(f"h{i}", None, "A. Hotun", None, "2020") for i in range(300)] + [("mine", "Effect of alginate and oat protein on lubrication of soy oil emulsions", "A. Hotun", None, "2020")]
    assert [(r.study_id, r.paper) for r in linked(spark, s, p)] == [("Hotun2020", "mine")]


TITLE = "{} of {} and {} protein on {} of {} oil emulsions".format
SLOTS = [(a, b, c, d) for a in ("pectin", "inulin") for b in ("soy", "whey") for c in ("creaminess", "viscosity") for d in ("corn", "olive")]


@pytest.mark.parametrize(("author", "frequent"), [(None, 5), ("A. Hotun", 5), ("A. Hotun", 50)])
def test_frequent_keys_are_refined_not_left_out(spark, author, frequent):
    """No word and no run of words belongs to one study alone, sixteen studies have the same author and year; however soon
    keys are refined, the links are those of all pairs."""
    s = [(f"Hotun2020{chr(97 + i)}", TITLE("Effect", *x), None, None) for i, x in enumerate(SLOTS)]
    p = [(f"h{i}", TITLE("Offect", *x), author, None, "2020") for i, x in enumerate(SLOTS)]
    names = ("author, year and whole title", "author, year and title words", "near year and runs of title words")
    assert {(r.study_id, r.paper) for r in linked(spark, s, p, names, frequent=frequent)} == {(f"Hotun2020{chr(97 + i)}", f"h{i}") for i in range(16)}


def test_a_key_of_most_rows(spark):
    """Nine rows in ten have one author and year; their pairs grow with the rows."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}zen" for i in range(400)]
    s = [(f"Hotun2020{chr(97 + i % 26)}{i}", f"Study {words[i]} with {words[(i * 7 + 3) % 400]} emulsions and foams", None, None) for i in range(400)] + [(f"Other{chr(97 + i)}ek2001", f"Gels of {words[i]}", None, None) for i in range(20)]
    p = [(f"h{i}", f"Study {words[i]} with {words[(i * 7 + 3) % 400]} emulsi0ns and foams", "A. Hotun", None, "2020") for i in range(400)]
    a, b = frames(spark, s, p)
    rule = next(r for group in study_rules() for r in group if r.name == "author, year and title words")
    assert linkage._candidates(a, b, "study_id", "paper", {0: rule}, 50).count() < 2_000  # not 160,000
    got = linked(spark, s, p, ("author, year and whole title", "author, year and title words"), frequent=50)
    assert len(got) == 400 and all(r.study_id.endswith(r.paper[1:]) for r in got)


def test_emulsion_is_no_emulsifier(spark):
    pairs = [(["emulsion", "protein"], ["emulsifier", "prot"]), (["emuls"], ["emulsions", "viscosity"]), ([], ["word"])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").select(common_share(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 1.0, 0.0]


def test_measured_values_decide(spark):
    """Two studies of one author and year without titles: the paper's values tell which is meant, whatever its other rows say."""
    rows = [("Valun2010a", 10.0, 4.0), ("Valun2010a", 12.0, 4.2), ("Valun2010b", 20.0, 2.2), ("Valun2010b", None, 2.4), ("Valun2010c", 90.0, 9.0)]
    s = spark.createDataFrame(rows, "study_id string, fat_concentration_pct double, d90_um double").selectExpr("*", "cast(null as string) title_short", "cast(null as string) journal", "'x' AS values")
    p = spark.createDataFrame([("v1", "A. Valun", "2010"), ("v2", "A. Valun", "2010"), ("v3", "A. Valun", "2010")], "paper string, author_line string, year_line string").selectExpr("*", "cast(null as string) title_line", "cast(null as string) journal_line")
    guide = spark.createDataFrame([("Fat_concentration_wt%", "Fat"), ("d90_µm", "d90")], "variable string, label string")
    values = [("v1", "Fat", "11 wt%"), ("V1.pdf", "d90_um", "4,1"), ("v2", "fat_concentration_wt%", "19"), ("v2", "d90_µm", "2.3"), ("v3", "Fat", "11"), ("v3", None, "1"), (None, "Fat", "1"), ("v3", "d90", "below 4"), ("v3", "d90", None)]
    measured = paper_values(spark.createDataFrame(values, "paper string, normalized_variable string, value string"), guide)
    a, b = studies(s), papers(p, measured)
    got = {r.paper: (r.study_id, r.rule) for r in link(a, b, "study_id", "paper", study_rules(), study_facts([])).collect()}
    assert got == {"v1": ("Valun2010a", "author, near year and measured values"), "v2": ("Valun2010b", "author, near year and measured values")}  # v3 has one value, which fits both a and b


def test_a_frequent_key_keeps_every_pair(spark):
    """Ten studies of one author and year that share no word with the paper: its values tell which is meant, however soon a key is frequent."""
    s = [(f"Valun2010{chr(97 + i)}", f"{chr(97 + i) * 3}zen {chr(97 + i) * 3}vor", float(10 * 2**i), float(40 / 2**i)) for i in range(10)]
    a = studies(spark.createDataFrame(s, "study_id string, title_short string, fat_concentration_pct double, d90_um double").selectExpr("*", "cast(null as string) journal"))
    p = spark.createDataFrame([("v1", "Zzzuv and zzzuw", "A. Valun", "2010")], "paper string, title_line string, author_line string, year_line string").selectExpr("*", "cast(null as string) journal_line")
    guide = spark.createDataFrame([("Fat_concentration_wt%", "Fat"), ("d90_µm", "d90")], "variable string, label string")
    measured = paper_values(spark.createDataFrame([("v1", "Fat", "41"), ("v1", "d90", "9.9")], "paper string, normalized_variable string, value string"), guide)
    b = papers(p, measured)
    for frequent in (1_000, 3):
        assert [(r.study_id, r.paper) for r in link(a, b, "study_id", "paper", study_rules(), study_facts([]), frequent=frequent).collect()] == [("Valun2010c", "v1")]


def test_frequent_runs_of_words_are_not_multiplied(spark, monkeypatch):
    """Sixty studies and papers whose titles of twelve words differ in one: what is written grows with the records, not with the subsets of their words."""
    words = "alginate pectin inulin gellan xanthan soy whey casein lupin potato canola".split()
    s = [(f"A{chr(97 + i % 26)}{chr(97 + i // 26)}tun2020", " ".join([*words, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zen"]), None, None) for i in range(60)]
    p = [(f"h{i}", title, None, None, "2020") for i, (_, title, _, _) in enumerate(s)]
    written, cut = [], linkage.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(linkage, "cut", counted)
    rules = ("near year and whole title", "near year and runs of title words")
    assert len(linked(spark, s, p, rules, frequent=10)) == 60
    assert sum(written) < 60 * 2 * 20


def test_equal_records_are_judged_once(spark):
    """Copies of a study tie, copies of a paper have one study; all papers are named."""
    s = [*STUDIES, *[(f"Cemolik2012{chr(97 + i)}", *STUDIES[4][1:]) for i in range(3)]]
    p = [*PAPERS, *[(f"p1{i}", *PAPERS[0][1:]) for i in range(3)]]
    got = {r.paper: r.study_id for r in linked(spark, s, p)}
    assert got == {"p1": "Alvarok2010", "p10": "Alvarok2010", "p11": "Alvarok2010", "p12": "Alvarok2010", "p2": "Alvarok2010b", "p3": "Berudan2015"}


RUNS = ("near year, journal and runs of any title words", "near year and runs of any title words")


def test_words_that_most_titles_have_make_keys(spark):
    """Every word is in half of the titles or in most, so that each counts as a phrase's: their runs still find the sixteen papers."""
    s = [(f"Hotun2020{chr(97 + i)}", TITLE("Effect", *x), "Dairy Fat Rep." if i % 2 else None, None) for i, x in enumerate(SLOTS)]
    p = [(f"h{i}", TITLE("Offect", *x), None, "Dairy and Fat Reports" if i % 2 else None, "2020") for i, x in enumerate(SLOTS)]
    a, b = frames(spark, s, p)
    usual = usual_words([a, b])
    assert all(share >= linkage.PHRASE for w, share in usual.items())
    for names in (RUNS, RUNS[1:], None):
        passes = [[r for r in group if names is None or r.name in names] for group in study_rules(usual)]
        got = link(a, b, "study_id", "paper", [group for group in passes if group], study_facts(list(usual))).collect()
        assert {(r.study_id, r.paper) for r in got} == {(f"Hotun2020{chr(97 + i)}", f"h{i}") for i in range(16)}


@pytest.mark.parametrize("piece", [20_000, 3])
def test_blocks_leave_the_pairs_that_keys_leave(spark, monkeypatch, piece):
    """Comparing all records of a block gives the pairs and votes of a join on the keys within it, in however many pieces."""
    monkeypatch.setattr(linkage, "PIECE", piece)
    words = "pectin soy whey inulin gellan oil emulsions creaming viscosity fat protein gel milk water".split()
    draw = lambda i, n: " ".join(words[(i * 5 + j * (1 + i % 3)) % 14] + ("q" if (i + j) % 11 == 0 else "") for j in range(n))
    s = [(f"{'Hotun' if i % 3 else 'Bexil'}20{10 + i % 3}{chr(97 + i % 26)}{i}", draw(i, 3 + i % 7), "Dairy Fat Rep." if i % 2 else None, None) for i in range(90)]
    p = [(f"h{i}", draw(i + i % 2, 2 + i % 8), "A. Hotun" if i % 4 == 0 else None, "Dairy and Fat Reports" if i % 3 else None, f"201{i % 4}, 2012") for i in range(90)] + [("none", None, None, None, None)]
    a, b = (df.withColumn("_alike", F.when(F.hash(id_) % 7 == 0, 2).otherwise(1).cast("bigint")) for df, id_ in zip(frames(spark, s, p), ("study_id", "paper"), strict=True))
    usual = usual_words([a, b])
    rules = dict(enumerate(r for group in study_rules(usual) for r in group if r.name in RUNS))
    joined = {n: dataclasses.replace(r, left=linkage._keys(r.block[0], r.left), right=linkage._keys(r.block[1], r.right), block=None) for n, r in rules.items()}
    facts = study_facts(list(usual))
    pairs = linkage._candidates(a, b, "study_id", "paper", joined, 100).where("_shared >= 2")
    want = linkage._judged(pairs.join(b, "paper").join(linkage._named(a, "study_id"), "study_id"), joined, facts).select("paper", "study_id", "_rule", "_votes", "_share", (F.col("l__alike") > 1).alias("_twin"))
    got = linkage._in_blocks(a, b, "study_id", "paper", rules, facts).collect()
    assert len(got) > 100 and {r._rule for r in got} == {0, 1} and any(r._votes for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_blocks_ask_the_join_for_bits_only(spark):
    """The planner moves no veto into the join of a block, where it would be asked of every pair instead of those whose titles' bits agree."""
    a, b = (df.withColumn("_alike", F.lit(1).cast("bigint")) for df in frames(spark))
    rules = dict(enumerate(r for group in study_rules() for r in group if r.name in RUNS))
    plan = linkage._in_blocks(a, b, "study_id", "paper", rules, study_facts(["pect"]))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("bit_count" in line for line in joins) and "levenshtein" in plan
    assert not any("levenshtein" in line or "array_intersect" in line for line in joins)


def test_words_of_runs_are_worked_out_once(spark):
    """The words without a phrase's stand once in a rule's keys, not once for each word, place and year."""
    for rule in (r for group in study_rules({"oil": 0.5}) for r in group):
        assert str(rule.left).count("array_except") <= 1 and str(rule.right).count("array_except") <= 1


def test_swapped_letters_are_a_misreading(spark):
    rows = [(["pectin"], ["pnctie"]), (["pectin"], ["pectinpectin"]), (["pectin"], ["potato"])]
    odd = linkage.odd_words(F.col("a"), F.lit(["zzzz"]), F.col("b"), F.lit(["pect"]))
    assert [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(odd).collect()] == [[], ["pectin"], ["pectin"]]


def test_shares_are_worked_out_once(spark):
    """A pair's share of words stands once in the plan: the planner doesn't ask for it in the join and then make it again."""
    a, b = (df.withColumn("_alike", F.lit(1).cast("bigint")) for df in frames(spark))
    rules = dict(enumerate(study_rules()[0]))
    pairs = linkage._candidates(a, b, "study_id", "paper", rules, 100)
    plan = linkage._judged(pairs.join(b, "paper").join(linkage._named(a, "study_id"), "study_id"), rules, study_facts())._jdf.queryExecution().optimizedPlan().toString()
    assert sum("StartsWith" in line for line in plan.splitlines()) == 1


def test_blocks_compare_keys_before_authors(spark):
    """Pairs of a block that don't have the rule's keys are left out before the authors' veto, which isn't compiled, asks for their whole rows."""
    a, b = (df.withColumn("_alike", F.lit(1).cast("bigint")) for df in frames(spark))
    rules = dict(enumerate(r for group in study_rules() for r in group if r.name in RUNS))
    plan = linkage._in_blocks(a, b, "study_id", "paper", rules, study_facts(["pect"]))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = lambda word: max(i for i, line in enumerate(plan) if word in line and "Filter" in line)  # noqa: E731  (plans are printed from the last step on)
    assert first("array_intersect(_keys") > first("levenshtein")


def test_plain_text_of_any_letters(spark):
    texts = ["Emul-\nsions of MÜLLER", "Oil-Water", "Ｆａｔ µ² ﬁlm", "Но́га", "éte", "", None, "Çà-\r\n et là"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(linkage.plain(F.col("t"))).collect()]
    assert got == ["emulsions of muller", "oil-water", "fat u2 film", "hoгa", "ete", "", None, "caet la"]
