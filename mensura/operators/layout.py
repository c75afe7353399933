"""Tables from the places of words on a page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.long import unpivot
from mensura.session import cut

NUMERIC = r"^-?\d+(\.\d+)?$"


def _rows_of(y: np.ndarray, tolerance: float) -> np.ndarray:
    """Row number of each word in reading order: a word joins the row if it is within the tolerance of the row's first word.

    A step for each row: the next row begins at the first word that is too far from the row's first one.
    """
    starts, at = [], 0
    while at < len(y):
        starts.append(at)
        ahead, width = at + 1, 64
        while ahead < len(y):  # looks ahead in growing steps, as rows are short
            far = np.abs(y[ahead : ahead + width] - y[at]) > tolerance
            if far.any():
                ahead += int(far.argmax())
                break
            ahead, width = ahead + width, 2 * width
        at = min(ahead, len(y))
    out = np.zeros(len(y), np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def word_rows(words: DataFrame, page: str, tolerance: float = 4.0) -> DataFrame:
    """words (page, x, y, text) with row_no (from 0) and position (from 0) in the row.

    Words are taken in order of y in steps of the tolerance (half to even), then x, y and text; a word joins the open
    row if its y is within the tolerance of the row's first word, else it opens one. Within a row words stand by x, y
    and text. Null places or texts are left out. The fold depends on all words of a page before it and runs page by page
    (a page is what fits on one); repeated words stay.
    """
    schema = f"{page} {words.schema[page].dataType.simpleString()}, x double, y double, text string, row_no bigint, position bigint"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_k=np.round(group.y / tolerance)).sort_values(["_k", "x", "y", "text"], kind="stable")
        group["row_no"] = _rows_of(group.y.to_numpy(), tolerance)
        group = group.sort_values(["row_no", "x", "y", "text"], kind="stable")
        group["position"] = group.groupby("row_no").cumcount()
        return group[[page, "x", "y", "text", "row_no", "position"]]

    rows = words.select(page, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text").where("x is not null and y is not null and text is not null")
    return rows.groupBy(page).applyInPandas(fold, schema)


def grid(rows: DataFrame, page: str, gap: float = 20.0) -> DataFrame:
    """(page, row_no, column_no, text): words of word_rows in columns.

    Column anchors of a page: its distinct x in order, a new one where x is more than the gap right of the last anchor. A
    word belongs to the nearest anchor (the left one of two); the words of a cell are joined by blanks in their order.
    """
    distinct = rows.select(page, "x").distinct()
    schema = f"{page} {rows.schema[page].dataType.simpleString()}, x double, column_no bigint"

    def columns(group: pd.DataFrame) -> pd.DataFrame:
        xs = np.sort(group.x.to_numpy())
        anchors = [xs[0]]
        for x in xs[1:]:
            if x - anchors[-1] > gap:
                anchors.append(x)
        a = np.array(anchors)
        right = np.clip(np.searchsorted(a, xs), 1, max(len(a) - 1, 1))
        left = right - 1
        near = np.where((len(a) > 1) & (np.abs(a[np.minimum(right, len(a) - 1)] - xs) < np.abs(xs - a[left])), right, left)
        return pd.DataFrame({page: group[page].iloc[0], "x": xs, "column_no": near})

    placed = rows.join(distinct.groupBy(page).applyInPandas(columns, schema), [page, "x"])
    cells = placed.groupBy(page, "row_no", "column_no").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_w"))
    return cells.select(page, "row_no", "column_no", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))


def numeric_share(cells: DataFrame, page: str) -> DataFrame:
    """(page, row_no, n_filled, numeric_share) of each row of a grid; the share is of all columns of the page, empty ones too."""
    width = cells.groupBy(page).agg((F.max("column_no") + 1).alias("_width"))
    rows = cells.groupBy(page, "row_no").agg(F.count("*").alias("n_filled"), F.count_if(F.col("text").rlike(NUMERIC)).alias("_n"))
    return rows.join(width, page).select(page, "row_no", "n_filled", (F.col("_n") / F.col("_width")).alias("numeric_share"))


def table_blocks(rows: DataFrame, page: str, ratio: float = 0.3, columns: int = 3, absorbed: int = 2, least: int = 3) -> DataFrame:
    """(page, block_no, first_row, last_row, n_rows): tables among the rows of numeric_share.

    A row qualifies with a numeric share of at least the ratio and at least so many filled cells. A table begins at one; up
    to `absorbed` other rows in a row are taken in, a further one ends it. Tables of fewer than `least` rows are none.
    rows must have every row of the page from 0 on; ordering is per page.
    """
    w = Window.partitionBy(page).orderBy("row_no")
    hit = (F.col("numeric_share") >= ratio) & (F.col("n_filled") >= columns)
    marked = rows.withColumn("_hit", F.when(hit, F.col("row_no")))
    last = F.last("_hit", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.last("_hit", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumns({"_last": last, "_new": (F.col("_hit").isNotNull() & (before.isNull() | (F.col("row_no") - before > absorbed + 1))).cast("int")})
    inside = marked.where(F.col("row_no") - F.col("_last") <= absorbed)
    numbered = inside.withColumn("_block", F.sum("_new").over(w))
    blocks = numbered.groupBy(page, "_block").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)
    return blocks.select(page, F.row_number().over(Window.partitionBy(page).orderBy("_block")).alias("block_no"), "first_row", "last_row", "n_rows")


def data_blocks(words: DataFrame, page: str, tolerance: float = 4.0, gap: float = 20.0, ratio: float = 0.3, columns: int = 3) -> DataFrame:
    """(page, block_no, row_no, column_no, text): the cells of the tables that the words of pages make.

    Words to rows, rows to a grid, numeric shares of the rows, tables among them (table_blocks), and their filled cells. Tables
    without two rows and `columns` columns with something in them are left out.
    """
    cells = cut(grid(word_rows(words, page, tolerance), page, gap))
    blocks = table_blocks(numeric_share(cells, page), page, ratio, columns)
    inside = cells.join(blocks, page).where("row_no between first_row and last_row")
    size = inside.groupBy(page, "block_no").agg(F.count_distinct("row_no").alias("_rows"), F.count_distinct("column_no").alias("_columns")).where(F.col("_columns") >= columns).where("_rows >= 2")
    return inside.join(size, [page, "block_no"], "left_semi").select(page, F.col("block_no").cast("bigint").alias("block_no"), "row_no", "column_no", "text")


def table_like(boxes: DataFrame, page: str, confident: Column, gap: float = 15.0, total: int = 16, rows: int = 4, columns: int = 3) -> DataFrame:
    """(page, n_boxes, n_rows, table_like) of pages of boxes (page, y).

    Confident boxes in order of y form a row as long as neighbours are at most the gap apart; a page is like a table with at
    least `total` boxes (confident or not) and `rows` rows of at least `columns` boxes.
    """
    w = Window.partitionBy(page).orderBy("y")
    sure = boxes.where(confident & F.col("y").isNotNull()).groupBy(page, "y").agg(F.count("*").alias("_n"))  # places, each once
    chained = sure.withColumn("_new", F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(0)))
    sized = chained.withColumn("_row", F.sum("_new").over(w)).groupBy(page, "_row").agg(F.sum("_n").alias("_n"))
    full = sized.groupBy(page).agg(F.count_if(F.col("_n") >= columns).alias("n_rows"))
    counts = boxes.groupBy(page).agg(F.count("*").alias("n_boxes"))
    return counts.join(full, page, "left").select(page, "n_boxes", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), ((F.col("n_boxes") >= total) & (F.coalesce("n_rows", F.lit(0)) >= rows)).alias("table_like"))


def design_rows(lines: DataFrame, keys: list[str], line: str, width: int = 5, runs: int = 20) -> DataFrame:
    """keys, run, block and three percentages of lines that hold exactly `width` numbers, the first from 1 to `runs`; decimal commas are read."""
    numbers = F.filter(F.transform(F.split(F.col(line), r"\s+"), lambda w: F.replace(w, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.isNotNull())
    rows = lines.withColumn("_n", numbers).where((F.size("_n") == width) & F.get("_n", F.lit(0)).between(1, runs))
    names = ("run", "block", "arabic_gum_pct", "xanthan_gum_pct", "orange_oil_pct")
    return rows.select(*keys, *[(F.get("_n", F.lit(i)).cast("bigint") if i < 2 else F.get("_n", F.lit(i))).alias(n) for i, n in enumerate(names)])


def left_column_design(words: DataFrame, page: str, width: float, part: float = 0.55, tolerance: float = 4.0) -> DataFrame:
    """Design rows of the left column of pages of the given width: words left of a part of it, in rows, that hold five numbers."""
    rows = word_rows(words.where(F.col("x") < part * width), page, tolerance)
    lines = rows.groupBy(page, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda w: w["text"]), " ").alias("_line"))
    return design_rows(lines, [page, "row_no"], "_line").orderBy(page, "run")


def positional(df: DataFrame, order: list[str], columns: dict[str, tuple[str, ...]], most: int = 20) -> DataFrame:
    """The first rows (by order) of a table of text, its columns by position: name -> source columns, of which the first that holds a number counts."""
    value = lambda c: F.replace(F.trim(F.col(f"`{c}`")), F.lit(","), F.lit(".")).try_cast("double")
    return df.orderBy(*order).limit(most).select(*[F.coalesce(*map(value, sources)).alias(name) for name, sources in columns.items()])


def levelled_lines(lines: DataFrame, page: str, names: list[str], most: int = 7) -> DataFrame:
    """(page, line_no, level, name, numbers, labelled): a table whose rows stand over several lines (page, line_no, line).

    A line that is one letter A to D sets the level; below a level, a line that contains one of the names, letter case
    aside, opens a row (name: the first of them), whose numbers stand on the lines after it: labels such as '12ab' are passed
    over, any other text ends the row, and `most` numbers complete it. labelled: a label stood among its numbers. The
    state is carried by windows over the page's lines.
    """
    w = Window.partitionBy(page).orderBy("line_no")
    level = F.when(F.col("line").rlike("^[A-D]$"), F.col("line"))
    named = F.coalesce(*[F.when(F.contains(F.lower("line"), F.lit(n.lower())), F.lit(n)) for n in names])
    value = F.replace("line", F.lit(","), F.lit("."))
    number = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))
    state = lines.withColumns({"_level": F.last(level, True).over(w), "_name": named, "_number": number})
    state = state.withColumn("_opens", F.when(F.col("_name").isNotNull() & F.col("_level").isNotNull(), F.col("line_no"))).withColumn("_open", F.last("_opens", True).over(w))
    kind = F.when(F.col("_opens").isNotNull(), "open").when(F.col("_number").isNotNull(), "number").when(F.col("line").rlike(r"^\d+[a-z]+$"), "label").otherwise("text")
    state = state.withColumn("_kind", kind)
    own = Window.partitionBy(page, "_open").orderBy("line_no")
    inside = state.where("_open is not null").withColumn("_ended", F.sum(F.when(F.col("_kind") == "text", 1).otherwise(0)).over(own)).where("_ended = 0")
    placed = inside.withColumn("_nth", F.sum(F.when(F.col("_kind") == "number", 1).otherwise(0)).over(own))
    rows = placed.groupBy(page, "_open").agg(
        F.max(F.when(F.col("_kind") == "open", F.col("_level"))).alias("level"), F.max(F.when(F.col("_kind") == "open", F.col("_name"))).alias("name"),
        F.array_sort(F.collect_list(F.when((F.col("_kind") == "number") & (F.col("_nth") <= most), F.struct("line_no", "_number")))).alias("_n"),
        F.coalesce(F.bool_or((F.col("_kind") == "label") & (F.col("_nth") < most)), F.lit(False)).alias("labelled"),
    )
    return rows.select(page, F.col("_open").alias("line_no"), "level", "name", F.transform("_n", lambda n: n["_number"]).alias("numbers"), "labelled")


#: Columns of a levelled table's numbers; the second one only stands in rows of seven numbers without a label.
LEVELLED = ("viscosity_9_5s1_mpas", "targeted_mpas", "viscosity_50s1_mpas", "viscosity_500s1_mpas", "shear_thinning_index", "d32_um", "d43_um")


def levelled_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the columns LEVELLED of rows of levelled_lines with at least six numbers."""
    n, whole = F.col("numbers"), (F.size("numbers") == 7) & ~F.col("labelled")
    at = lambda i: F.get(n, F.when(whole, i).otherwise(0 if i == 0 else i - 1))
    columns = [F.when(whole, F.get(n, F.lit(1))).alias(c) if i == 1 else at(i).alias(c) for i, c in enumerate(LEVELLED)]
    return rows.where(F.size("numbers") >= 6).select(*keys, *columns)


def levelled_observations(columns: DataFrame, keys: list[str], fat: Column) -> DataFrame:
    """keys, variable, value, unit, relation_method, confidence: the long form of a levelled table; viscosity in Pa·s, null values left out."""
    pairs = [("Fat_concentration_wt%", fat, "wt%"), ("Viscosity_Pa_s", F.col("viscosity_50s1_mpas") / 1000, "Pa.s"), ("d90_µm", F.col("d43_um"), "µm")]
    units = F.coalesce(*[F.when(F.col("variable") == v, F.lit(u)) for v, _, u in pairs])
    return unpivot(columns, keys, [(v, x) for v, x, _ in pairs]).select(*keys, "variable", "value", units.alias("unit"), F.lit("table").alias("relation_method"), F.lit(0.95).alias("confidence"))
