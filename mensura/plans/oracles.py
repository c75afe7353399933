"""SQL of the queries that SQL can express, for another engine to check them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from mensura.functions.keys import BLANKS, LATIN, LOOKALIKES, MISSING, SPACES
from mensura.functions.names import ascii_column
from mensura.functions.numbers import NOT_ONE, QUANTITY
from mensura.plans.problems import MEASURED
from mensura.plans.reference import COLUMNS, CURATED, VARIABLES, VISCOSITIES
from mensura.schema import BODY_END, CATEGORIES, CONFIDENCE, EVALUATED, FEATURE_PATTERNS, IMAGE_NAMES, IMAGE_PATTERNS, IMAGE_RANGED, INPUTS, LABEL_STEPS, MORE_NOISE, NOISE, OIL_TYPES, OIL_WORDS, OUTPUTS, PROTEIN_WORDS, RANGES, SENSORY, TEXT_NAMES, TEXT_PATTERNS, UNITS, VARIABLE_UNITS

#: Unicode's white space as a class of the other engine's patterns.
BLANK = r"[\s\x{0B}\x{85}\pZ]"
TEMPERATURE, PRESSURE = VARIABLES["Temperature_C"], VARIABLES["Pressure_MPa"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(names: Sequence[str]) -> str:
    return "(" + ", ".join(map(_q, names)) + ")"


def _case(key: str, table: Mapping[str, object], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def _pattern(p: str) -> str:
    """A pattern with Unicode's blanks and digits, as the queries' flags have them."""
    return _q("(?i)" + p.replace(r"\s", BLANK).replace(r"\d", r"\p{Nd}").replace("[" + r"\p{Nd}" + ",]", r"[\p{Nd},]"))


NUMBER = r"regexp_matches({0}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')"
OBS = f"obs AS (SELECT row_id, paper, normalized_variable AS variable, value AS value_raw, CASE WHEN {NUMBER.format('value')} THEN TRY_CAST(trim(value) AS DOUBLE) END AS value, unit, relation_method, sheet, entity, source FROM extended_with_ocr)"
PIVOT = f"{OBS}, pivoted AS (SELECT paper, " + ", ".join(f"median(value) FILTER (WHERE variable = {_q(v)}) AS {c}" for v, c in VARIABLES.items()) + f" FROM obs WHERE value IS NOT NULL AND paper IS NOT NULL AND variable IN {_in(list(VARIABLES))} GROUP BY paper)"
_scaled = {VARIABLES[v]: f"CASE WHEN {VARIABLES[v]} > 10 THEN round({VARIABLES[v]} / 10, 3) ELSE {VARIABLES[v]} END AS {VARIABLES[v]}" for v in SENSORY}
METHOD = "CASE WHEN contains(lower(coalesce(sheet, '')), 'ocr') THEN 'OCR' WHEN ends_with(lower(coalesce(sheet, '')), 'ext') OR contains(lower(coalesce(sheet, '')), 'table') THEN 'Table' ELSE 'NLP' END"
CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')"
LINES = f"lines AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(parts[i], '^{BLANK}+|{BLANK}+$', '', 'g') AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)) WHERE regexp_replace(parts[i], '^{BLANK}+|{BLANK}+$', '', 'g') <> '')"
_nan = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


def _ranged(value: str, names: Sequence[str], variable: str = "variable") -> str:
    number = f"TRY_CAST(replace({value}, ',', '') AS DOUBLE)"
    return "coalesce(CASE " + " ".join(f"WHEN {variable} = {_q(v)} THEN {number} BETWEEN {RANGES[v][0]} AND {RANGES[v][1]}" for v in names) + " ELSE true END, true)"


_bare = "trim(entity, " + " || ".join(f"chr({ord(c)})" for c in SPACES) + ")"
_e = f"lower({_bare})"
NOISY = rf"coalesce(length({_e}) < 3 OR regexp_matches({_e}, '^(fig\.?|figure|table|eq\.?)\s*\d*$') OR regexp_matches({_e}, '^\d+\.?\d*$') OR regexp_matches({_bare}, '^[A-Z]{{2,6}}$') OR {_e} IN {_in(NOISE)}, true)"


def _label(name: str) -> str:
    for a, b in LABEL_STEPS:
        name = f"replace({name}, {_q(a)}, {_q(b)})"
    return name


def _extract(source: str, keys: str, patterns: Sequence[tuple[str, str, str | None]]) -> str:
    """Accepted matches of a pattern library: all matches with their places, then a fold over them in order of priority."""
    steps = []
    for i, (variable, p, unit) in enumerate(patterns):
        rx = _pattern(p)
        units = f"regexp_extract_all(sentence, {rx}, 2)" if unit is None else f"list_transform(w{i}, lambda z: {_q(unit)})"
        steps.append((f"regexp_extract_all(sentence, {rx}, 0) AS w{i}, regexp_extract_all(sentence, {rx}, 1) AS v{i}, regexp_split_to_array(sentence, {rx}) AS b{i}", f"{units} AS u{i}", f"list_transform(range(1, len(w{i}) + 1), lambda k: {{'s': coalesce(list_sum(list_transform(b{i}[1:k], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(w{i}[1:k-1], lambda z: length(z))), 0), 'l': length(w{i}[k]), 'variable': {_q(variable)}, 'entity': w{i}[k], 'value': v{i}[k], 'unit': u{i}[k]}})"))
    raw = f"SELECT {keys}, sentence, " + ", ".join(s[0] for s in steps) + f" FROM {source} WHERE sentence IS NOT NULL"
    units = "SELECT *, " + ", ".join(s[1] for s in steps) + f" FROM ({raw})"
    found = f"SELECT {keys}, flatten([{', '.join(s[2] for s in steps)}]) AS a FROM ({units})"
    kept = f"SELECT {keys}, list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].s < y.s + y.l AND y.s < x[1].s + x[1].l)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM ({found}) WHERE len(a) > 0"
    return f"SELECT {keys}, m.s::INTEGER AS start, m.variable AS variable, m.entity AS entity, m.value AS value, m.unit AS unit FROM (SELECT {keys}, unnest(kept) AS m FROM ({kept}))"


def _category() -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(entity), {_q(w)})" for w in ws) + f" THEN {_q(c)}" for c, ws in CATEGORIES.items()) + " END"


def _flag(words: Sequence[str]) -> str:
    return "CASE WHEN text IS NOT NULL THEN CASE WHEN " + " OR ".join(f"contains(lower(text), {_q(w)})" for w in words) + " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END"


def _hits(p: str, group: int) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), {_pattern(p)}, {group}))), '|')"


BOXES = "boxes AS (SELECT l_suppkey AS page, (l_linenumber * 25 + l_suppkey % 3)::DOUBLE AS x, ((l_orderkey % 40) * 6 + l_partkey % 4)::DOUBLE AS y, l_quantity::INTEGER::VARCHAR AS text FROM lineitem)"
WORD_ROWS = f"""{BOXES}, ordered AS (SELECT page, list({{'x': x, 'y': y, 't': text}} ORDER BY round_even(y / 4, 0), x, y, text) AS ws FROM boxes GROUP BY page),
folded AS (SELECT page, ws, list_reduce(list_transform(ws, lambda w: [{{'a': w.y, 'r': 0::BIGINT}}]), lambda acc, w: list_concat(acc, [CASE WHEN abs(w[1].a - acc[len(acc)].a) > 4 THEN {{'a': w[1].a, 'r': acc[len(acc)].r + 1}} ELSE acc[len(acc)] END])) AS rs FROM ordered),
placed AS (SELECT page, ws[i].x AS x, ws[i].y AS y, ws[i].t AS text, rs[i].r AS row_no FROM (SELECT page, ws, rs, unnest(generate_series(1, len(ws))) AS i FROM folded)),
word_rows AS (SELECT *, row_number() OVER (PARTITION BY page, row_no ORDER BY x, y, text) - 1 AS position FROM placed)"""
NEAR = f"xs AS (SELECT page, list(x ORDER BY x) AS xs FROM (SELECT DISTINCT page, x FROM word_rows) GROUP BY page), anchors AS (SELECT page, xs, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] > 20 THEN list_concat(acc, x) ELSE acc END) AS a FROM xs), near AS (SELECT page, x, list_sort(list_transform(range(0, len(a)), lambda i: {{'d': abs(a[i + 1] - x), 'i': i}}))[1].i AS column_no FROM (SELECT page, a, unnest(xs) AS x FROM anchors)), "
PREDICTIONS = "joined AS (SELECT l_returnflag AS target, l_extendedprice / l_quantity AS actual, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey), predictions AS (SELECT 'brand' AS model, target, actual, avg(actual) OVER (PARTITION BY p_brand) AS predicted FROM joined UNION ALL SELECT 'size', target, actual, avg(actual) OVER (PARTITION BY p_size) FROM joined), metrics AS (SELECT target, model, count(*) AS n, round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse, round(avg(abs(actual - predicted)), 4) AS mae, round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)), 4) AS r2 FROM predictions GROUP BY target, model)"
_t, _g = _nan("gt_value"), _nan("pipeline_value")
DETAIL = f"detail AS (SELECT variable, study_id, CASE WHEN t IS NULL THEN NULL WHEN g IS NULL THEN 'miss' WHEN CASE WHEN variable NOT IN {_in(SENSORY)} THEN coalesce(abs(g - t) / nullif(abs(t), 0) <= 0.2, false) ELSE abs(g - t) <= 1.0 END THEN 'hit' ELSE 'off' END AS match, abs(g - t) AS error, 100 * (abs(g - t) / nullif(abs(t), 0)) AS relative_error FROM (SELECT variable, study_id, {_t} AS t, {_g} AS g FROM evaluation_results))"
_words = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_stripped = "replace(replace(replace(replace(paper, '1-s2.0-', ''), '-mainext', ''), '-main', ''), '-v2', '')"

#: Pieces of the problems' SQL: keys, blanks and names as the queries compare them.
FROM_, TO_ = LOOKALIKES + "".join(chr(c) for c in range(0xFF01, 0xFF5F)), LATIN + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def stripped(text: str) -> str:
    return f"trim({text}, {_blanks})"


def is_filled(text: str) -> str:
    return f"coalesce(lower({stripped(text)}) NOT IN {_in(MISSING)}, false)"


def name_key(text: str) -> str:
    return f"regexp_replace(lower(translate({text}, {_q(FROM_)}, {_q(TO_)})), '[^a-z0-9]+', '', 'g')"


def file_key(text: str) -> str:
    stem = f"regexp_replace({stripped(text)}, '^.*[/\\\\]', '')"
    return name_key(f"regexp_replace({stem}, '(?i)\\.pdf$', '')")


NAMES = f"names AS (SELECT k, max(variable) AS variable FROM (SELECT {name_key('variable')} AS k, variable FROM variable_guide UNION ALL SELECT {name_key('label')}, variable FROM variable_guide) GROUP BY k)"
PAPERS = f"papers AS (SELECT {file_key('paper')} AS paper_key, min(paper) AS paper FROM paper_headers GROUP BY 1)"


def _number(text: str) -> str:
    t = f"translate({stripped(text)}, ',−', '.-')"
    return f"CASE WHEN regexp_matches({t}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST({t} AS DOUBLE) END"


def _states_one(text: str) -> str:
    t = f"translate({stripped(text)}, chr(160) || chr(8201) || chr(8239), '   ')"
    return f"(regexp_matches({t}, {_q(QUANTITY)}) AND NOT regexp_matches({t}, {_q(NOT_ONE)}))"


def _differences() -> str:
    key = lambda c: f"lower(regexp_replace(translate({c}, {_q(FROM_)}, {_q(TO_)}), '[\\s\\x{{85}}\\pZ\\x{{0B}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]+', '', 'g'))".replace("{{", "{").replace("}}", "}")
    verdict = f"CASE WHEN {is_filled('verdict')} THEN lower({stripped('verdict')}) END"
    one = lambda name, table, gt, pv, at: f"{name} AS (SELECT v, s, gt, pv, vd FROM (SELECT *, row_number() OVER (PARTITION BY v, s ORDER BY {at} DESC, gt DESC NULLS LAST, pv DESC NULLS LAST, vd DESC NULLS LAST) AS n FROM (SELECT {key('variable')} AS v, {key('study_id')} AS s, {at}, {gt} AS gt, {pv} AS pv, {verdict} AS vd FROM {table})) WHERE n = 1)"
    a = one("a", "evaluation_results", _nan("gt_value"), _nan("pipeline_value"), "evaluated_at")
    b = one("b", "evaluation_results_copy", _number("gt_value"), _number("pipeline_value"), "copied_at")
    apart = lambda f: f"(a.{f} IS NULL) <> (b.{f} IS NULL) OR abs(a.{f} - b.{f}) > 0.0005 + 1e-9"
    both = "FROM a JOIN b ON a.v = b.v AND a.s = b.s WHERE "
    parts = [
        "SELECT a.v, a.s, 'only_in_results' AS field_name FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.v = b.v AND a.s = b.s)", "SELECT b.v, b.s, 'only_in_copy' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.v = b.v AND a.s = b.s)",
        f"SELECT a.v, a.s, 'gt_value' {both}{apart('gt')}", f"SELECT a.v, a.s, 'pipeline_value' {both}{apart('pv')}", f"SELECT a.v, a.s, 'verdict' {both}a.vd IS DISTINCT FROM b.vd",
    ]
    studies = f"studies AS (SELECT {name_key('study_id')} AS k, min({stripped('study_id')}) AS spelled FROM example_data GROUP BY 1)"
    return f"WITH {a}, {b}, {NAMES}, {studies}, d AS ({' UNION ALL '.join(parts)}) SELECT coalesce(n.variable, d.v) AS variable, coalesce(t.spelled, d.s) AS study_id, field_name FROM d LEFT JOIN names n ON {name_key('d.v')} = n.k LEFT JOIN studies t ON {name_key('d.s')} = t.k"


def _changes() -> str:
    melted = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS v FROM wide_format_dataset" for c in MEASURED)
    stats = "SELECT load_id, column_name, 1 - count(v) / count(*) AS nulls, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, count(DISTINCT v) / nullif(count(v), 0) AS dis FROM m GROUP BY 1, 2"
    pairs = ", ".join(f"{c}, lag({c}) OVER w AS old_{c}" for c in ("nulls", "med", "iqr", "dis"))
    apart = lambda c, f: f"CASE WHEN {c} IS NULL OR old_{c} IS NULL THEN ({c} IS NULL) <> (old_{c} IS NULL) WHEN {c} <= 0 OR old_{c} <= 0 THEN ({c} <= 0) <> (old_{c} <= 0) OR {c} <> old_{c} ELSE greatest({c}, old_{c}) > {f} * least({c}, old_{c}) END"
    return f"WITH m AS ({melted}), s AS ({stats}), p AS (SELECT load_id, column_name, {pairs}, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY column_name ORDER BY load_id)) SELECT load_id::BIGINT AS load_id, column_name FROM p WHERE n > 1 AND (abs(nulls - old_nulls) > 0.15 OR {apart('med', 1.5)} OR {apart('iqr', 2.0)} OR {apart('dis', 3.0)})"


def _truth() -> str:
    """Collected against extracted values, a row per study and variable."""
    sources = {"d90_µm": ["d90_um"], "Viscosity_Pa_s": list(VISCOSITIES), "Sensory_thickness": ["mean_thickness_10"], "Sensory_creaminess": ["mean_creaminess_10"], "Temperature_C": ["sample_preparation_temperature_c", "viscosity_measurement_temperature_c"]}
    study = "study AS (SELECT trim(study_id) AS study_id, " + ", ".join(f"median({_nan(c)}) AS {c}" for cs in sources.values() for c in cs) + " FROM example_data GROUP BY 1)"
    named = "headers AS (SELECT DISTINCT paper, regexp_extract(year_line, '((?:19|20)[0-9]{2})', 1) AS year, unnest(regexp_extract_all(lower(author_line), '[a-z]{4,}')) AS author FROM paper_headers), named AS (SELECT e.study_id, min(h.paper) AS paper FROM (SELECT DISTINCT trim(study_id) AS study_id, regexp_extract(lower(trim(study_id)), '^[a-z]+', 0) AS author, regexp_extract(trim(study_id), '((?:19|20)[0-9]{2})', 1) AS year FROM example_data) e JOIN headers h ON e.author = h.author AND e.year = h.year WHERE e.year <> '' GROUP BY 1)"
    each = " UNION ALL ".join(
        f"SELECT {_q(v)} AS variable, s.study_id, list_median(list_filter([{', '.join(f's.{c}' for c in sources[v])}], lambda x: x IS NOT NULL)) * {factor} AS t, {_scaled.get(VARIABLES[v], f'p.{VARIABLES[v]}').removesuffix(' AS ' + VARIABLES[v])} AS g, {str(relative).lower()} AS relative FROM study s JOIN named n ON s.study_id = n.study_id LEFT JOIN pivoted p ON n.paper = p.paper"
        for v, factor, relative in EVALUATED
    )
    return f"{PIVOT}, {study}, {named}, e AS ({each}), detail AS (SELECT variable, study_id, t, g, CASE WHEN g IS NULL THEN 'miss' WHEN CASE WHEN relative THEN coalesce(abs(g - t) / nullif(abs(t), 0) <= 0.2, false) ELSE abs(g - t) <= 1.0 END THEN 'hit' ELSE 'off' END AS match, abs(g - t) AS error, 100 * (abs(g - t) / nullif(abs(t), 0)) AS relative_error FROM e WHERE t IS NOT NULL)"


SUMMARY = "c AS (SELECT variable, count(*) FILTER (WHERE match = 'hit') AS tp, count(*) FILTER (WHERE match = 'off') AS fp, count(*) FILTER (WHERE match = 'miss') AS fn, round(avg(error), 4) AS mean_abs_error, round(median(relative_error), 1) AS median_rel_error_pct FROM detail WHERE match IS NOT NULL GROUP BY variable), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c) SELECT variable, tp, fp, fn, round(p, 3) AS precision, round(q, 3) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 3) AS f1, mean_abs_error, median_rel_error_pct FROM r"


def _images() -> str:
    """Observations of images from boxes of text; tables images, useful and rows."""
    words = "[q || ' °C', q || 'O rpm', q || ' MPa', q || '% fat', q || ',5 mL', 'd90 = ' || q || ' nm']"
    items = f"items AS (SELECT 'p' || (l_partkey % 40) AS paper, 'img' || l_partkey AS source, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS nth, ((l_orderkey % 8) * 20)::DOUBLE AS y, ({words})[(1 + l_orderkey % 6)::INTEGER] AS text, 1 - l_discount * 3 AS conf FROM (SELECT *, l_quantity::INTEGER::VARCHAR AS q FROM lineitem))"
    large = "images AS (SELECT DISTINCT 'p' || (p_partkey % 40) AS paper, 'img' || p_partkey AS source FROM part WHERE p_size * 20 >= 150 AND 100 + p_partkey % 400 >= 150), boxes AS (SELECT i.* FROM items i JOIN images g ON i.paper = g.paper AND i.source = g.source)"
    repaired = r"array_to_string(list_transform(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY nth), '\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN translate(w, 'OolIBSZG', '00118526') ELSE w END), ' ')"
    texts = f"texts AS (SELECT paper, source, {repaired} AS sentence FROM boxes WHERE conf >= 0.8 GROUP BY 1, 2)"
    gate = "chained AS (SELECT paper, source, sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY paper, source ORDER BY y) AS r FROM (SELECT *, y - lag(y) OVER (PARTITION BY paper, source ORDER BY y) AS gap FROM boxes WHERE conf >= 0.8)), gate AS (SELECT paper, source FROM (SELECT paper, source, r, count(*) AS k FROM chained GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE k >= 3) >= 4), many AS (SELECT paper, source FROM boxes GROUP BY 1, 2 HAVING count(*) >= 16)"
    useful = "useful AS (SELECT t.* FROM texts t JOIN gate g ON t.paper = g.paper AND t.source = g.source JOIN many m ON t.paper = m.paper AND t.source = m.source WHERE length(sentence) >= 20)"
    rows = f"found AS ({_extract('useful', 'paper, source', IMAGE_PATTERNS)}), rows AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY paper, source, value) AS k FROM found) WHERE k <= 3 AND {_ranged('value', IMAGE_RANGED)})"
    return f"WITH {items}, {large}, {texts}, {gate}, {useful}, {rows}"


def _parsed(text: str) -> str:
    """The number that a text which states one quantity states."""
    t = f"translate({stripped(text)}, chr(160) || chr(8201) || chr(8239), '   ')"
    n = f"translate(regexp_extract({t}, {_q(QUANTITY)}, 1), '− ' || chr(39), '-')"
    last = lambda mark: f"strpos(reverse({n}), '{mark}')"
    number = f"CASE WHEN contains({n}, ',') AND contains({n}, '.') THEN CASE WHEN {last(',')} < {last('.')} THEN replace(replace({n}, '.', ''), ',', '.') ELSE replace({n}, ',', '') END WHEN length({n}) - length(replace({n}, ',', '')) > 1 THEN replace({n}, ',', '') WHEN length({n}) - length(replace({n}, '.', '')) > 1 THEN replace({n}, '.', '') ELSE replace({n}, ',', '.') END"
    power = f"regexp_replace(translate(regexp_extract({t}, {_q(QUANTITY)}, 2), '⁺⁻−⁰¹²³⁴⁵⁶⁷⁸⁹', '+--0123456789'), '^\\s*(?:[eE]|[×x*·]\\s*10\\s*(?:\\^|\\*\\*)?)\\s*', 'e')"
    return f"CASE WHEN {_states_one(text)} THEN TRY_CAST(({number}) || {power} AS DOUBLE) END"


def _resolved_rows(unknown: bool) -> str:
    variable = f"coalesce(n.variable, CASE WHEN {is_filled('o.normalized_variable')} THEN {stripped('o.normalized_variable')} END)" if unknown else "n.variable"
    return f"{NAMES}, {PAPERS}, rows AS (SELECT p.paper, {variable} AS variable, n.variable IS NOT NULL AS known, CASE WHEN {is_filled('o.value')} THEN o.value END AS value FROM extended_with_ocr o JOIN papers p ON {file_key('o.paper')} = p.paper_key LEFT JOIN names n ON {name_key('o.normalized_variable')} = n.k)"


def _wide(columns: Sequence[str]) -> str:
    counts = lambda what: f"string_agg(variable || '=' || {what}, '|' ORDER BY variable)"
    cells = f"cells AS (SELECT paper, variable, known, quantile_disc(x, 0.5) AS x, count(x) AS n, count(*) FILTER (WHERE value IS NOT NULL AND x IS NULL) AS failed FROM (SELECT *, {_parsed('value')} AS x FROM rows WHERE variable IS NOT NULL) GROUP BY 1, 2, 3)"
    pivot = ", ".join(f"max(x) FILTER (WHERE variable = {_q(v)}) AS {ascii_column(v)}" for v in columns)
    return f"WITH {_resolved_rows(True)}, {cells} SELECT paper, {pivot}, coalesce({counts('failed')} FILTER (WHERE known AND failed > 0), '') AS cast_failures, coalesce({counts('n')} FILTER (WHERE NOT known), '') AS other FROM cells GROUP BY paper"


def _profile(columns: Mapping[str, bool]) -> str:
    """The profile of columns (name -> it is a number), load by load."""
    text = lambda c, number: f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::VARCHAR END" if number else f"{c}::VARCHAR"
    cells = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {text(c, number)} AS v, {f'CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END' if number else 'NULL::DOUBLE'} AS x FROM wide_format_dataset" for c, number in columns.items())
    mask = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '\p{Lu}+', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}B-Z]+', 'a', 'g'), '\p{N}+', '9', 'g'), '[\s\x{0B}\x{85}\pZ]+', ' ', 'g')"
    stats = "s AS (SELECT load_id, column_name, count(*) AS n_rows, count(v) AS n_filled, count(DISTINCT v) AS n_distinct, min(x) AS min_number, max(x) AS max_number, min(v) FILTER (WHERE x IS NULL) AS min_value, max(v) FILTER (WHERE x IS NULL) AS max_value, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM m GROUP BY 1, 2)"
    masks = f"k AS (SELECT load_id, column_name, mask, n, n / sum(n) OVER (PARTITION BY load_id, column_name) AS share FROM (SELECT load_id, column_name, {mask} AS mask, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY 1, 2, 3)), d AS (SELECT load_id, column_name, arg_min(mask, (-n, mask)) AS dominant_mask, count(*) AS n_masks, coalesce(string_agg(mask || '=' || n, '|' ORDER BY mask) FILTER (WHERE share < 0.01), '') AS rare_masks, coalesce(sum(n) FILTER (WHERE share < 0.01), 0)::BIGINT AS n_violations FROM k GROUP BY 1, 2)"
    loads = "l AS (SELECT load_id, lag(load_id) OVER (ORDER BY load_id) AS before FROM (SELECT DISTINCT load_id FROM wide_format_dataset))"
    gap = "j AS (SELECT load_id, column_name, mask, sum(p) AS p, sum(r) AS r FROM (SELECT load_id, column_name, mask, share AS p, 0.0::DOUBLE AS r FROM k UNION ALL SELECT l.load_id, column_name, mask, 0.0, share FROM k JOIN l ON k.load_id = l.before) GROUP BY 1, 2, 3), g AS (SELECT load_id, column_name, CASE WHEN sum(p) > 0 AND sum(r) > 0 THEN sum(0.5 * CASE WHEN p > 0 THEN p * log2(2 * p / (p + r)) ELSE 0 END + 0.5 * CASE WHEN r > 0 THEN r * log2(2 * r / (p + r)) ELSE 0 END) END AS mask_divergence FROM j GROUP BY 1, 2)"
    return f"WITH m AS ({cells}), {stats}, {masks}, {loads}, {gap} SELECT s.load_id::BIGINT AS load_id, s.column_name, n_rows, n_filled, 1 - n_filled / n_rows AS null_share, n_distinct, n_distinct / nullif(n_filled, 0) AS distinct_share, min_number, max_number, min_value, max_value, q1, median, q3, q3 - q1 AS iqr, dominant_mask, coalesce(n_masks, 0) AS n_masks, coalesce(rare_masks, '') AS rare_masks, coalesce(n_violations, 0) AS n_violations, round(mask_divergence, 9) AS mask_divergence FROM s LEFT JOIN d ON s.load_id = d.load_id AND s.column_name = d.column_name LEFT JOIN g ON s.load_id = g.load_id AND s.column_name = g.column_name"


ORACLES: dict[str, str] = {
    "p2_found": _differences(),
    "p4_found": f"WITH {NAMES}, {PAPERS} SELECT DISTINCT p.paper, n.variable AS normalized_variable FROM extended_with_ocr o JOIN papers p ON {file_key('o.paper')} = p.paper_key JOIN names n ON {name_key('o.normalized_variable')} = n.k WHERE {is_filled('o.value')} AND {_states_one('o.value')}",
    "p5_found": _changes(),
    "p5_profile": _profile({**dict.fromkeys(MEASURED, True), "wide_id": True, **dict.fromkeys(("loaded_at", "study_id", "paper"), False)}),
    "p4_wide": _wide(sorted(VARIABLES)),
    "p4_cast_failures": f"WITH {_resolved_rows(False)} SELECT paper, variable AS normalized_variable, value, count(*) AS n FROM rows WHERE variable IS NOT NULL AND value IS NOT NULL AND NOT {_states_one('value')} GROUP BY 1, 2, 3",
    "wide_median_pivot": f"WITH {PIVOT} SELECT * FROM pivoted",
    "wide_unmapped_kept": f"WITH {OBS} SELECT paper, count(*) FILTER (WHERE variable IN {_in(list(VARIABLES))}) = 0 AS nothing_mapped FROM obs WHERE value IS NOT NULL AND paper IS NOT NULL GROUP BY paper",
    "wide_rescaled": f"WITH {PIVOT} SELECT paper, {', '.join(_scaled.values())} FROM pivoted",
    "wide_with_counts": f"WITH {PIVOT}, counts AS (SELECT paper, count(value) AS rows_extracted FROM obs GROUP BY paper) SELECT p.paper, {', '.join(_scaled.get(c, c) for c in COLUMNS)}, rows_extracted FROM pivoted p LEFT JOIN counts c ON p.paper = c.paper",
    "coverage_report": f"WITH {PIVOT}, melted AS (" + " UNION ALL ".join(f"SELECT {_q(v)} AS variable, {c} AS value FROM pivoted" for v, c in VARIABLES.items()) + f") SELECT variable, {_label('variable')} AS label, CASE WHEN variable IN {_in(INPUTS)} THEN 'Input' WHEN variable IN {_in(OUTPUTS)} THEN 'Output' ELSE 'Other' END AS var_role, count(value) AS n_filled, round(100 * count(value) / count(*), 1) AS pct_filled, round(median(value), 4) AS median_value FROM melted GROUP BY variable",
    "presence_matrix": f"WITH {PIVOT} SELECT paper, {', '.join(f'({c} IS NOT NULL)::INTEGER AS {c}' for c in COLUMNS)} FROM pivoted",
    "method_share": f"WITH {OBS} SELECT {METHOD} AS method, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM obs WHERE value IS NOT NULL GROUP BY 1",
    "sheets_per_method": f"SELECT {METHOD} AS method, count(DISTINCT sheet) AS n_sheets FROM extended_with_ocr WHERE sheet IS NOT NULL GROUP BY 1",
    "distinct_counts": f"WITH {OBS} SELECT count(DISTINCT paper) AS n_papers, count(DISTINCT variable) AS n_variables, count(DISTINCT entity) AS n_entities, count(value) AS n_values, count(*) AS n_rows FROM obs",
    "value_stats": f"WITH {OBS} SELECT variable, count(*) AS n, min(value) AS min_value, max(value) AS max_value, median(value) AS median_value FROM obs WHERE value IS NOT NULL AND variable IS NOT NULL GROUP BY variable HAVING count(*) >= 3",
    "histogram_bins": f"WITH {OBS}, v AS (SELECT variable, value, min(value) OVER w AS low, max(value) OVER w AS high, least(10, count(*) OVER w) AS bins FROM obs WHERE value IS NOT NULL AND variable IN {_in(list(VARIABLES))} WINDOW w AS (PARTITION BY variable)) SELECT variable, CASE WHEN high = low THEN 0 ELSE least(bins - 1, floor((value - low) * bins / (high - low))) END::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1, 2",
    "extraction_counts": f"WITH {OBS} SELECT paper, count(*) AS n_rows, count(*) FILTER (WHERE relation_method = 'pattern') AS n_pattern, count(*) FILTER (WHERE coalesce(relation_method <> 'pattern', true)) AS n_other, count(value) AS n_valued FROM obs GROUP BY paper",
    "pattern_extract": _extract("extended_with_ocr", "row_id", TEXT_PATTERNS),
    "pattern_extract_images": f"SELECT variable, count(*) AS n, sum(start)::BIGINT AS starts FROM ({_extract('(SELECT row_id, sentence FROM extended_with_ocr WHERE source IS NOT NULL)', 'row_id', IMAGE_PATTERNS)}) WHERE {_ranged('value', IMAGE_RANGED)} GROUP BY variable",
    "regex_distinct_hits": f"SELECT doc_id, {_hits(r'\d+(?:\.\d+)?\s*°c', 0)} AS temperatures, {_hits(r'\d+(?:\.\d+)?\s*wt\.?\s*%', 0)} AS concentrations, {_hits(r'(\d+)\s+participants', 1)} AS participants, {_hits(r'\d+(?:\.\d+)?\s*[µμu]m', 0)} AS sizes, array_to_string(list_filter(CASE WHEN text IS NOT NULL THEN {list(OIL_TYPES)} END, lambda o: contains(lower(text), o)), '|') AS oils FROM documents",
    "feature_medians": "WITH " + ", ".join(f"f{i} AS (SELECT paper, median(TRY_CAST(replace(v, ',', '') AS DOUBLE)) AS m FROM (SELECT paper, unnest(regexp_extract_all(text, {_pattern(p)}, 1)) AS v FROM documents) GROUP BY paper)" for i, (_, p) in enumerate(FEATURE_PATTERNS)) + " SELECT d.paper, " + ", ".join(f"f{i}.m AS {VARIABLES[n]}" for i, (n, _) in enumerate(FEATURE_PATTERNS)) + " FROM (SELECT DISTINCT paper FROM documents) d " + " ".join(f"LEFT JOIN f{i} ON d.paper IS NOT DISTINCT FROM f{i}.paper" for i in range(len(FEATURE_PATTERNS))),
    "keyword_flags": f"SELECT doc_id, {_flag(PROTEIN_WORDS)} AS protein_type, {_flag(OIL_WORDS)} AS oil_fat_type FROM documents",
    "body_slice": rf"WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?is)\bAbstract\b') THEN regexp_extract(text, '(?is)\bAbstract\b.*', 0) ELSE text END AS t FROM documents), b AS (SELECT doc_id, CASE WHEN regexp_matches(t, {_q('(?is)' + BODY_END)}) THEN regexp_extract(t, {_q('(?is)^(.*?)' + BODY_END)}, 1) ELSE t END AS t FROM a) SELECT doc_id, coalesce(length(t), 0) AS n_body, md5(t) AS body_md5 FROM b",
    "clean_text": f"SELECT doc_id, coalesce(length({CLEAN}), 0) AS n_clean, md5({CLEAN}) AS clean_md5 FROM documents",
    "sentence_split": rf"WITH s AS (SELECT doc_id, string_split(regexp_replace({CLEAN}, '([.!?]) +([A-Z0-9])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM s) SELECT doc_id, (i - 1)::INTEGER AS sentence_no, trim(parts[i]) AS sentence FROM e WHERE length(trim(parts[i])) >= 20",
    "document_lines": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM lines GROUP BY doc_id",
    "noise_filter": f"SELECT row_id, entity FROM extended_with_ocr WHERE (coalesce(relation_method = 'pattern', false) OR NOT {NOISY}) AND NOT coalesce(lower(entity) IN {_in(MORE_NOISE)}, false)",
    "classify_normalise": f"SELECT entity, relation_method, variable, {_category()} AS category, {_case(_e, TEXT_NAMES)} AS named, {_case(_e, IMAGE_NAMES)} AS named_in_image, split_part(variable, '_', 1) AS pattern_category, ({_case('relation_method', CONFIDENCE)})::DOUBLE AS confidence FROM (SELECT DISTINCT entity, relation_method, normalized_variable AS variable FROM extended_with_ocr)",
    "range_filter": f"SELECT normalized_variable AS variable, {_ranged('value', list(RANGES), 'normalized_variable')} AS plausible, count(*) AS n FROM extended_with_ocr WHERE value IS NOT NULL GROUP BY 1, 2",
    "nullified_values": rf"WITH n AS (SELECT *, value IS NULL OR (regexp_matches(value, '\p{{Nd}}') AND {_ranged('value', list(RANGES), 'normalized_variable')}) AS good FROM extended_with_ocr) SELECT row_id, CASE WHEN good THEN value END AS value_raw, CASE WHEN good THEN unit END AS unit, CASE WHEN good THEN relation_method ELSE 'none' END AS relation_method FROM n",
    "proximity_link": rf"WITH w AS (SELECT row_id, {_words.format('sentence')} AS w FROM extended_with_ocr WHERE sentence IS NOT NULL), p AS (SELECT row_id, w, list_sort(list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN regexp_matches(w[i + 1], '^[0-9]+([.,][0-9]+)?$') THEN {{'d': abs(i - (len(w) - 1) / 2), 'i': i}} END), lambda z: z IS NOT NULL)) AS c FROM w) SELECT row_id, c[1].i AS at, w[c[1].i + 1] AS number, CASE WHEN lower(w[c[1].i + 2]) IN {_in(UNITS)} THEN lower(w[c[1].i + 2]) END AS unit FROM p WHERE len(c) > 0",
    "axis_tick_filter": "SELECT row_id, value AS value_raw FROM (SELECT row_id, value, count(*) OVER (PARTITION BY paper, source, value) AS n FROM extended_with_ocr WHERE source IS NOT NULL) WHERE n <= 3",
    "digit_repair": rf"SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '\p{{Nd}}') THEN translate(w, 'OolIBSZG', '00118526') ELSE w END), ' ')) AS repaired_md5 FROM documents",
    "labels": f"SELECT paper, CASE WHEN starts_with({_stripped}, 'S') AND length({_stripped}) > 8 THEN substr({_stripped}, 1, 14) ELSE trim(substr({_stripped}, 1, 22), '-_ ') END AS study_label, CASE WHEN starts_with(paper, '1-s2.0-') OR starts_with(paper, 'S0') OR starts_with(paper, 'S2') THEN trim(substr(replace(paper, '1-s2.0-', ''), 1, 18), '-_ ') ELSE substr(array_to_string(({_words.format("replace(paper, '-', ' ')")})[1:4], ' '), 1, 28) END AS paper_label, paper AS stem FROM paper_headers",
    "unpivot_long": "SELECT * FROM (" + " UNION ALL ".join([f"SELECT row_no, 'd90_um' AS variable, {_nan('d90_um')} AS value FROM example_data", *[f"SELECT row_no, 'viscosity_pa_s', {_nan(c)} / 1000 FROM example_data" for c in VISCOSITIES], f"SELECT row_no, 'fat_concentration_wt', {_nan('fat_concentration_pct')} FROM example_data"]) + ") WHERE value IS NOT NULL",
    "union_observations": "SELECT variable, unit, relation_method, load_id, count(*) AS n FROM (SELECT normalized_variable AS variable, unit, relation_method, NULL::VARCHAR AS load_id FROM extended_with_ocr UNION ALL SELECT 'Viscosity_Pa_s', NULL, NULL, load_id::VARCHAR FROM wide_format_dataset WHERE viscosity_pa_s IS NOT NULL) GROUP BY ALL",
    "group_median": f"SELECT trim(study_id) AS study, {', '.join(f'median({_nan(c)}) AS {c}' for c in CURATED)} FROM example_data GROUP BY 1",
    "row_median": f"SELECT row_no, list_median(list_filter([{', '.join(_nan(c) for c in VISCOSITIES)}], lambda x: x IS NOT NULL)) * 0.001 AS viscosity_pa_s FROM example_data",
    "design_outputs_join": "SELECT r.study_id, r.variable, r.verdict, count(*) AS n_rows, min(d.oil_type) AS first_oil FROM (SELECT trim(study_id) AS study_id, oil_type FROM example_data) d JOIN evaluation_results r ON d.study_id = r.study_id GROUP BY 1, 2, 3",
    "key_mapping_lookup": "SELECT g.label, g.var_type, count(*) AS n FROM evaluation_results r LEFT JOIN variable_guide g ON r.variable = g.variable GROUP BY 1, 2",
    "semi_anti_split": "SELECT variable, side, count(*) AS n FROM (SELECT r.variable, CASE WHEN EXISTS (SELECT 1 FROM evaluation_results_copy c WHERE c.variable = r.variable AND c.study_id = r.study_id) THEN 'held' ELSE 'rest' END AS side FROM evaluation_results r) GROUP BY 1, 2",
    "eval_detail": f"WITH {DETAIL} SELECT variable, study_id, match, round(error, 4) AS abs_error, round(relative_error, 2) AS rel_error_pct FROM detail",
    "eval_summary": f"WITH {DETAIL}, {SUMMARY}",
    "truth_detail": f"WITH {_truth()} SELECT variable, study_id, round(t + 1e-9, 4) AS gt_value, round(g + 1e-9, 4) AS pipeline_value, round(error + 1e-9, 4) AS abs_error, round(relative_error + 1e-9, 2) AS rel_error_pct, match FROM detail",
    "truth_summary": f"WITH {_truth()}, {SUMMARY}",
    "image_enrichment": f"{_images()} SELECT variable AS normalized_variable, unit, count(*) AS n, count(DISTINCT source) AS n_images, sum(TRY_CAST(value AS DOUBLE)) AS total FROM rows GROUP BY 1, 2",
    "image_statistics": f"{_images()} SELECT i.paper, i.n AS images_found, coalesce(u.n, 0) AS useful_images, coalesce(r.n, 0) AS rows_extracted FROM (SELECT paper, count(*) AS n FROM images GROUP BY 1) i LEFT JOIN (SELECT paper, count(*) AS n FROM useful GROUP BY 1) u ON i.paper = u.paper LEFT JOIN (SELECT paper, count(*) AS n FROM rows GROUP BY 1) r ON i.paper = r.paper",
    "variable_catalogue": f"WITH {OBS} SELECT variable, {_case('variable', {v: i for i, v in enumerate((*INPUTS, *OUTPUTS))}, str(len(INPUTS) + len(OUTPUTS)))} AS place, {_label('variable')} AS label, {_case('variable', VARIABLE_UNITS)} AS unit, CASE WHEN variable IN {_in(INPUTS)} THEN 'Input' WHEN variable IN {_in(OUTPUTS)} THEN 'Output' ELSE 'Other' END AS var_role, count(*) AS n_values, count(DISTINCT paper) AS n_papers FROM obs WHERE value IS NOT NULL AND variable IS NOT NULL GROUP BY variable",
    "word_rows": f"WITH {WORD_ROWS} SELECT page, row_no, count(*) AS n_words, min(y) AS top, max(y) AS bottom, sum(position * x) AS spread FROM word_rows GROUP BY page, row_no",
    "word_grid": f"WITH {WORD_ROWS}, {NEAR}cells AS (SELECT w.page, row_no, column_no, sum(length(text)) + count(*) - 1 AS n FROM word_rows w JOIN near n ON w.page = n.page AND w.x = n.x GROUP BY 1, 2, 3) SELECT page, column_no, count(*) AS n_cells, sum(n)::BIGINT AS n_chars FROM cells GROUP BY 1, 2",
    "data_blocks": rf"WITH {WORD_ROWS}, {NEAR}cells AS (SELECT w.page, row_no, column_no, string_agg(text, ' ' ORDER BY position) AS text FROM word_rows w JOIN near n ON w.page = n.page AND w.x = n.x GROUP BY 1, 2, 3), width AS (SELECT page, max(column_no) + 1 AS width FROM cells GROUP BY 1), r AS (SELECT c.page, row_no, count(*) AS n_filled, count(*) FILTER (WHERE regexp_matches(text, '^-?\d+(\.\d+)?$')) / any_value(width) AS numeric_share FROM cells c JOIN width w ON c.page = w.page GROUP BY 1, 2), h AS (SELECT *, CASE WHEN numeric_share >= 0.3 AND n_filled >= 3 THEN row_no END AS hit FROM r), l AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY page ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lq, last_value(hit IGNORE NULLS) OVER (PARTITION BY page ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pq FROM h), m AS (SELECT *, (hit IS NOT NULL AND (pq IS NULL OR row_no - pq > 3))::INTEGER AS fresh FROM l), b AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY row_no) AS block FROM m WHERE row_no - lq <= 2), g AS (SELECT page, block, min(row_no) AS first_row, max(row_no) AS last_row FROM b GROUP BY 1, 2 HAVING count(*) >= 3), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY block) AS block_no FROM g) SELECT o.page, block_no, count(DISTINCT row_no) AS n_filled_rows, count(DISTINCT column_no) AS n_columns, count(*) AS n_cells, sum(length(text))::BIGINT AS n_chars FROM o JOIN cells c ON o.page = c.page AND row_no BETWEEN first_row AND last_row GROUP BY 1, 2 HAVING count(DISTINCT row_no) >= 2 AND count(DISTINCT column_no) >= 3",
    "table_blocks": "WITH r AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, o_orderkey % 7 AS n_filled, (o_orderkey % 11) / 10 AS numeric_share FROM orders), h AS (SELECT *, CASE WHEN numeric_share >= 0.3 AND n_filled >= 3 THEN row_no END AS hit FROM r), l AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY page ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lq, last_value(hit IGNORE NULLS) OVER (PARTITION BY page ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pq FROM h), m AS (SELECT *, (hit IS NOT NULL AND (pq IS NULL OR row_no - pq > 3))::INTEGER AS fresh FROM l), b AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY row_no) AS block FROM m WHERE row_no - lq <= 2), g AS (SELECT page, block, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS n_rows FROM b GROUP BY 1, 2 HAVING count(*) >= 3) SELECT page, row_number() OVER (PARTITION BY page ORDER BY block) AS block_no, first_row, last_row, n_rows FROM g",
    "table_layout_gate": "WITH b AS (SELECT l_partkey AS page, ((l_suppkey % 50) * 9)::DOUBLE AS y, l_discount AS conf FROM lineitem), s AS (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM b WHERE conf >= 0.02), c AS (SELECT page, sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y) AS r FROM s), n AS (SELECT page, count(*) FILTER (WHERE k >= 3) AS n_rows FROM (SELECT page, r, count(*) AS k FROM c GROUP BY page, r) GROUP BY page), t AS (SELECT page, count(*) AS n_boxes FROM b GROUP BY page) SELECT t.page, n_boxes, coalesce(n_rows, 0) AS n_rows, n_boxes >= 16 AND coalesce(n_rows, 0) >= 4 AS table_like FROM t LEFT JOIN n ON t.page = n.page",
    "numeric_cells": rf"WITH {LINES}, w AS (SELECT doc_id, line_no, {_words.format('line')} AS w FROM lines), s AS (SELECT doc_id, line_no, len(w) AS filled, len(list_filter(w, lambda x: regexp_matches(x, '^-?\d+(\.\d+)?$'))) AS numeric FROM w WHERE len(w) > 0), d AS (SELECT *, max(filled) OVER (PARTITION BY doc_id) AS width FROM s) SELECT doc_id, count(*) AS n_rows, sum(filled)::BIGINT AS n_filled, round(sum(numeric / width), 6) AS shares FROM d GROUP BY doc_id",
    "design_matrix": rf"WITH {LINES}, n AS (SELECT doc_id, line_no, list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda w: CASE WHEN regexp_matches(replace(w, ',', '.'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?$') THEN TRY_CAST(rtrim(replace(w, ',', '.'), 'dDfF') AS DOUBLE) END), lambda x: x IS NOT NULL) AS n FROM lines) SELECT doc_id, line_no::INTEGER AS line_no, trunc(n[1])::BIGINT AS run, trunc(n[2])::BIGINT AS block, n[3] AS arabic_gum_pct, n[4] AS xanthan_gum_pct, n[5] AS orange_oil_pct FROM n WHERE len(n) = 5 AND n[1] BETWEEN 1 AND 20",
    "levelled_table": r"WITH l AS (SELECT o_custkey AS page, o_orderkey * 5 + i AS line_no, CASE i WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'MCT oil' WHEN 1 THEN 'Olive oil' ELSE 'note' END WHEN 2 THEN (o_orderkey % 90)::VARCHAR || ',5' WHEN 3 THEN '12ab' ELSE (o_custkey % 70)::VARCHAR END AS line FROM orders, (SELECT unnest(generate_series(0, 4)) AS i)), s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-D]$') THEN line END IGNORE NULLS) OVER w AS level, last_value(CASE WHEN line IN ('MCT oil', 'Olive oil') THEN line_no END IGNORE NULLS) OVER w AS opened, TRY_CAST(replace(line, ',', '.') AS DOUBLE) AS number, line IN ('MCT oil', 'Olive oil') AS opens FROM l WINDOW w AS (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), e AS (SELECT *, sum((NOT opens AND number IS NULL AND NOT regexp_matches(line, '^\d+[a-z]+$'))::INTEGER) OVER (PARTITION BY page, opened ORDER BY line_no) AS ended FROM s WHERE opened IS NOT NULL), k AS (SELECT *, sum((number IS NOT NULL)::INTEGER) OVER (PARTITION BY page, opened ORDER BY line_no) AS nth FROM e WHERE ended = 0) SELECT page, opened AS line_no, max(level) FILTER (WHERE opens) AS level, max(line) FILTER (WHERE opens) AS name, count(*) FILTER (WHERE number IS NOT NULL AND nth <= 7) AS n_numbers, round(coalesce(sum(number) FILTER (WHERE nth <= 7), 0), 3) AS total FROM k GROUP BY page, opened",
    "regression_metrics": f"WITH {PREDICTIONS} SELECT * FROM metrics",
    "best_model": f"WITH {PREDICTIONS} SELECT target, arg_max(model, r2) AS model, max(r2) AS r2 FROM metrics GROUP BY target",
    "impute_median": f"WITH {PIVOT} SELECT paper, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM pivoted), 0.0) AS {c}" for c in (TEMPERATURE, PRESSURE)) + " FROM pivoted",
    "ridge_fit": "WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS x, avg(ln(1 + l_extendedprice)) AS y, var_pop(l_quantity) AS v, covar_pop(l_quantity, ln(1 + l_extendedprice)) AS c FROM lineitem), b AS (SELECT *, n * c / (n * v + 10) AS beta FROM m) SELECT 'intercept' AS term, round(y - beta * x, 8) AS coefficient FROM b UNION ALL SELECT 'quantity', round(beta, 8) FROM b",
}
