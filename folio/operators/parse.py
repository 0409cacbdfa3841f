"""Line-structured text to typed rows.

Every parser returns accepted rows and rejects in one DataFrame, told apart by a
``reject`` column (NULL = accepted), so that the input is read once. ``accepted`` and
``rejected`` pick one side; ``require_clean`` raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio import constants as K
from folio.functions import text as X
from folio.functions.rows import unroll
from folio.operators.ordered import scan_ordered


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject IS NULL").drop("reject")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject IS NOT NULL")


def require_clean(parsed: DataFrame) -> DataFrame:
    """Accepted rows; raises when there is any reject."""
    bad = rejected(parsed).limit(1).collect()
    if bad:
        raise ValueError(f"rejected input row: {bad[0].asDict()}")
    return accepted(parsed)


def text_lines(docs: DataFrame, text: str) -> DataFrame:
    """One row per line with its number; ``text`` is replaced by ``line_no, line``."""
    keep = [c for c in docs.columns if c != text]
    return unroll(docs, keep, X.lines_of(F.col(text)), "line_no", "line")


def section_rows(
    lines: DataFrame,
    titles: list[str] | None = None,
    sep: str = "  ",
    stop_on_blank: bool = True,
    path: str = "path",
    line_no: str = "line_no",
) -> DataFrame:
    """Rows of a sectioned table: four fields per line, the section title above them.

    Lines before the first title get ``''`` as their type. The file ends at its first
    blank line unless ``stop_on_blank`` is off. Extra fields are ignored.
    """
    line = F.col("line")
    is_title = line.isin(K.SECTION_TITLES if titles is None else titles)
    scanned = scan_ordered(
        lines,
        [path],
        line_no,
        latest={"type": F.when(is_title, line)},
        first_seq={"_end": line == ""},
    )
    body = scanned.filter(~is_title & (line != ""))
    if stop_on_blank:
        body = body.filter(F.col("_end").isNull() | (F.col(line_no) < F.col("_end")))
    f = X.fields_of(line, sep)
    return body.select(
        path,
        line_no,
        F.get(f, F.lit(0)).alias("medicine_a"),
        F.get(f, F.lit(1)).alias("medicine_b"),
        F.get(f, F.lit(2)).alias("dosage"),
        F.get(f, F.lit(3)).alias("function"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.when(F.size(f) < 4, F.lit("fewer than 4 fields")).alias("reject"),
    )


def line_role(line: Column) -> Column:
    """header, ingredients, method or NULL (ignored)."""
    dose, formula, water = K.DOSE_WORD, K.FORMULA_WORD, K.WATER_WORD
    has = lambda word: F.contains(line, F.lit(word))
    return (
        F.when(X.is_numbered(line), "header")
        .when(line.startswith(dose) | has(water), "method")
        .when((line != "") & ~has(dose) & ~has(formula), "ingredients")
    )


def formula_name(header: Column) -> Column:
    """Text between the first dot and the first 方, plus 方."""
    before = X.head_before(header, K.FORMULA_WORD)
    return F.concat(X.strip(X.tail_after(before, ".")), F.lit(K.FORMULA_WORD))


def formula_items(lines: DataFrame, path: str = "path", line_no: str = "line_no") -> DataFrame:
    """Long form: one row per line that says something about a formula.

    ``formula_no`` counts headers in the file; lines before the first header are
    rejects, because they belong to no formula.
    """
    line = F.col("line")
    scanned = scan_ordered(lines, [path], line_no, running_count={"formula_no": line_role(line) == "header"})
    tagged = scanned.select(*lines.columns, line_role(line).alias("role"), "formula_no")
    return tagged.filter("role IS NOT NULL").withColumn(
        "reject", F.when(F.col("formula_no") == 0, F.lit("before the first header"))
    )


def formula_parse(lines: DataFrame, path: str = "path", line_no: str = "line_no") -> DataFrame:
    """One row per formula: name, ingredients and methods in text order."""
    items = accepted(formula_items(lines, path, line_no))
    line, role = F.col("line"), F.col("role")
    in_order = Window.partitionBy(path, "formula_no").orderBy(line_no)
    formula = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def all_of(wanted: str) -> Column:
        return F.collect_list(F.when(role == wanted, line)).over(formula)

    # Rows of a formula are still together, so a window needs no shuffle, and keeps texts as they are.
    gathered = items.select(
        path,
        "formula_no",
        F.row_number().over(in_order).alias("_n"),
        F.max(F.when(role == "header", line)).over(formula).alias("_header"),
        all_of("ingredients").alias("_ingredients"),
        all_of("method").alias("methods"),
    )
    return gathered.filter("_n = 1").select(
        path,
        "formula_no",
        formula_name(F.col("_header")).alias("name"),
        F.flatten(F.transform("_ingredients", X.items_of)).alias("ingredients"),
        "methods",
    )


def formula_qa(formulas: DataFrame) -> DataFrame:
    """Question/answer text of each formula."""
    keep = [c for c in formulas.columns if c not in ("name", "ingredients", "methods")]
    return formulas.select(
        *keep,
        F.concat(
            F.lit(K.INGREDIENTS_MARK),
            F.array_join("ingredients", "\n"),
            F.lit("\n" + K.METHODS_MARK),
            F.array_join("methods", "\n"),
        ).alias("input"),
        F.concat(F.lit(K.NAME_MARK), "name").alias("output"),
    )


def qa_extract(qa: DataFrame) -> DataFrame:
    """Bare ingredient text and bare name of each question/answer row.

    Rows with an empty side or without both question markers are filtered out. NULLs
    and answers without their marker are rejects.
    """
    q, a = F.col("input"), F.col("output")
    missing = q.isNull() | a.isNull()
    kept = (F.length(q) > 0) & (F.length(a) > 0)
    marked = F.contains(q, F.lit(K.INGREDIENTS_MARK)) & F.contains(q, F.lit(K.METHODS_MARK))
    bare = X.remove(X.between(q, K.INGREDIENTS_MARK, K.METHODS_MARK), "\n")
    name = X.piece_after(a, K.NAME_MARK)
    others = [c for c in qa.columns if c not in ("input", "output")]
    reason = F.when(missing, "missing value").when(~F.contains(a, F.lit(K.NAME_MARK)), "no name marker")
    return qa.filter(missing | (kept & marked)).select(
        *others,
        F.when(reason.isNull(), bare).otherwise(q).alias("input"),
        F.when(reason.isNull(), name).otherwise(a).alias("output"),
        reason.alias("reject"),
    )
