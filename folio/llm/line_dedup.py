"""Repeated runs of lines, found by winnowing over line hashes.

A document is the sequence of its lines that are not blank, trimmed of white space; a
line weighs as many words as it has. A gram is a line and as many of the next as make
``GRAM_WORDS`` words; its hash is that of its lines' hashes. Over the grams inside each
stretch of lines of ``RUN_WORDS`` words the least hash is selected. Two documents that
share a run of that many words hold the same whole stretch, so both select the same gram
in it.

A selected gram is joined with its first selected occurrence, in the order of document
and line. The pair gives a diagonal: a document, an earlier place, and the distance
between their lines. Along a diagonal both documents are compared line by line, which
extends the match both ways, and every run of equal lines of ``GRAM_WORDS`` words or
more is a repeat: its lines in the later place are deleted.

A gram's first place need not be where the whole run occurs earlier. So whole stretches
are hashed as well, those from each line on and those up to each line, and the lines of
every stretch whose hash has an earlier place are deleted. Each line of a repeated run of
``RUN_WORDS`` words lies in such a stretch: the guarantee, at whatever place it occurs
earlier. Only documents that have a diagonal are hashed. If neither place of a stretch is the first
of its gram, both documents have one; otherwise the diagonal itself covers the stretch.

Only hashes, places and weights are shuffled, a few dozen bytes per line, and text once,
to the lines that go. A gram that very many documents share is reduced to its first
place before the shuffle, and the join back is one that Spark can split. A diagonal's
lines are those of one document.

Defined results: null and empty texts have no lines and stay as they are; documents are
ordered by id (null first), rows that share an id by a hash of their text, and rows equal
in both count as one place, so none is deleted for the other's sake; repeats within a
document are deleted too; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.session import write_once

RUN_WORDS = 50  # a repeated run of so many words is always found
GRAM_WORDS = 25  # words that a run must have to be deleted
SPACE = " \t\n\x0b\x0c\r"


def text_hash(text: Column) -> Column:
    """The first 60 bits of an md5, a hash that other engines can compute too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def document_key(id: str, body: Column) -> Column:
    """Orders and names documents: by id, and rows that share it by their text's hash."""
    return F.struct(F.col(id).alias("id"), text_hash(body).alias("digest"))


def joined_hash(hashes: Column) -> Column:
    return text_hash(F.concat_ws(",", F.transform(hashes, lambda h: h.cast("string"))))


def document_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, pos, line_no, h, words): lines that are not blank; ``doc`` orders and names documents."""
    body = F.col(text).cast("string")
    doc = document_key(id, body)
    lines = docs.select(doc.alias("doc"), F.posexplode(F.split(body, "\n")).alias("line_no", "_line"))
    trimmed = lines.select("doc", "line_no", F.btrim("_line", F.lit(SPACE)).alias("_line")).filter("_line <> ''")
    measured = trimmed.select(
        "doc",
        "line_no",
        text_hash(F.col("_line")).alias("h"),
        F.size(F.split("_line", "[ \t\n\x0b\x0c\r]+")).alias("words"),
    )
    # Rows equal in id and text are one document.
    return measured.groupBy("doc", "line_no").agg(F.first("h").alias("h"), F.first("words").alias("words"))


def selected_grams(lines: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc, pos, gram): the least gram of each stretch. ``lines`` has ``pos`` and ``before``."""
    by_words = Window.partitionBy("doc").orderBy("before")
    gram = by_words.rangeBetween(0, gram_words - 1)
    stretch = by_words.rangeBetween(0, run_words - 1)
    ends = F.col("before") + F.col("words")
    grams = lines.withColumn("_end", F.max(ends).over(gram)).withColumn(
        "_gram", F.when(F.col("_end") - F.col("before") >= gram_words, joined_hash(F.collect_list("h").over(gram)))
    )
    found = grams.select(
        "doc",
        "before",
        F.max(ends).over(stretch).alias("_stretch_end"),
        F.collect_list(F.struct(F.col("_gram").alias("gram"), F.col("pos").alias("pos"), F.col("_end").alias("end"))).over(stretch).alias("_grams"),
    ).filter(F.col("_stretch_end") - F.col("before") >= run_words)
    inside = F.filter("_grams", lambda g: g["gram"].isNotNull() & (g["end"] <= F.col("_stretch_end")))
    return found.select("doc", F.array_min(inside).alias("_g")).select("doc", "_g.pos", "_g.gram").distinct()


def diagonals(grams: DataFrame) -> DataFrame:
    """(doc, first_doc, shift): ``pos + shift`` in ``first_doc`` is the earlier place of ``pos``."""
    place = F.struct("doc", "pos")
    first = grams.groupBy("gram").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first < _last")
    met = grams.join(first.select("gram", "_first"), "gram").filter(F.col("_first") < F.struct("doc", "pos"))
    return met.select("doc", F.col("_first.doc").alias("first_doc"), (F.col("_first.pos") - F.col("pos")).alias("shift")).distinct()


def repeated_lines(lines: DataFrame, found: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc, line_no) of the lines to delete: runs of equal lines along the diagonals."""
    ours = lines.select("doc", "pos", "line_no", "h", "words").join(found, "doc")
    theirs = lines.select(F.col("doc").alias("first_doc"), F.col("pos").alias("_at"), F.col("h").alias("_h"))
    equal = ours.withColumn("_at", F.col("pos") + F.col("shift")).join(theirs, ["first_doc", "_at"]).filter("h = _h")
    diagonal = ["doc", "first_doc", "shift"]
    runs = equal.withColumn("_run", F.col("pos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("pos")))
    weight = F.sum("words").over(Window.partitionBy(*diagonal, "_run"))
    return runs.withColumn("_weight", weight).filter(F.col("_weight") >= gram_words).select("doc", "line_no").distinct()


def repeated_stretches(lines: DataFrame, found: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc, line_no) of the lines to delete: stretches that have an earlier place in a document of ``found``."""
    end = F.col("before") + F.col("words")
    inside = lines.withColumn("end", end).join(found.select("doc").distinct(), "doc", "left_semi")
    by_doc = Window.partitionBy("doc")
    after = by_doc.orderBy("before").rangeBetween(0, run_words - 1)
    upto = by_doc.orderBy("end").rangeBetween(1 - run_words, 0)

    def stretch(over: Window) -> Column:
        whole = F.max("end").over(over) - F.min("before").over(over) >= run_words
        hashed = joined_hash(F.collect_list("h").over(over))
        return F.when(whole, F.struct(hashed.alias("stretch"), F.min("pos").over(over).alias("pos"), F.max("pos").over(over).alias("until")))

    both = inside.select("doc", F.array(stretch(after), stretch(upto)).alias("_both"))
    stretches = both.select("doc", F.explode(F.array_compact(F.array_distinct("_both"))).alias("_s")).select("doc", "_s.*")
    place = F.struct("doc", "pos")
    first = stretches.groupBy("stretch").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first < _last")
    again = stretches.join(first.select("stretch", "_first"), "stretch").filter(F.col("_first") < place)
    # A line goes if a stretch from it or from a line before it reaches it.
    ends = again.groupBy("doc", "pos").agg(F.max("until").alias("until"))
    marked = inside.select("doc", "pos", "line_no", F.lit(None).cast("int").alias("until")).unionByName(
        ends.select("doc", "pos", F.lit(None).cast("int").alias("line_no"), "until")
    )
    reach = F.max("until").over(by_doc.orderBy("pos"))
    return marked.withColumn("_reach", reach).filter("line_no IS NOT NULL AND _reach >= pos").select("doc", "line_no")


def find_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS
) -> DataFrame:
    """(doc, lines): line numbers to delete, ascending, of each document that has any."""
    along = Window.partitionBy("doc").orderBy("line_no")
    measured = document_lines(docs, id, text)
    lines = write_once(
        measured.select(
            "doc",
            (F.row_number().over(along) - 1).alias("pos"),
            "line_no",
            "h",
            "words",
            (F.sum("words").over(along) - F.col("words")).alias("before"),
        )
    )
    found = write_once(diagonals(write_once(selected_grams(lines, run_words, gram_words))))
    gone = repeated_lines(lines, found, gram_words).unionByName(repeated_stretches(lines, found, run_words))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def delete_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    run_words: int = RUN_WORDS,
    gram_words: int = GRAM_WORDS,
    deleted: str = "deleted_lines",
) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``, all lines of every run of ``run_words``
    words that occurs earlier among them; their numbers in a new array column."""
    if deleted in docs.columns:
        raise ValueError(f"docs already has a column {deleted}; choose another name")
    gone = find_repeats(docs, id, text, run_words, gram_words)
    key, body = "_doc", F.col(text).cast("string")
    while any(f"{key}{end}" in docs.columns for end in ("", "of", "lines", "gone")):
        key += "_"
    doc = document_key(id, body)
    keyed = docs.withColumn(key, doc).withColumn(f"{key}lines", F.split(body, "\n")).drop(text)
    gone = gone.select(F.col("doc").alias(f"{key}of"), F.col("lines").alias(f"{key}gone"))
    joined = keyed.join(gone, F.col(key).eqNullSafe(F.col(f"{key}of")), "left")
    lines = F.col(f"{key}lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{key}gone"))
    kept = F.when(F.col(f"{key}gone").isNull(), lines).otherwise(F.transform(left, lambda k: F.get(lines, k)))
    return joined.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.col(f"{key}gone"), F.array().cast("array<int>")).alias(deleted),
    )
