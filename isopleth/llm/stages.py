"""Stages of the corpus pipeline: each takes and returns rows of `documents`, with any further columns.

Every stage works on all rows it is given. Rows with a null doc_id or text are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, mixing, neardup, pii, scorers


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.5 or more; the machine is fitted on the labels of documents it may see."""
    common.ship(spark)
    common.small_batches(spark)
    return scorers.kept(docs, scorers.train_quality(docs, common.table(spark, sf_dir, "labels")))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        out.append(name)
    return out


def _with(docs: DataFrame, name: str, rows: DataFrame, names: list[str], how: str) -> DataFrame:
    """Documents (with the print `name`) joined to rows (doc_id, print, ...) by both, null ids included; names: for the first two."""
    rows = common.cut(rows.toDF(*names, *rows.columns[2:]))
    if rows.count() <= neardup.BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col(names[0])) & (docs[name] == F.col(names[1])), how)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; others go, and repeated rows too.

    Five words and a similarity of 0.8. Rows are told apart by id and text: an id may stand for several texts, and each
    is decided on its own. Documents with a null id stay.
    """
    common.small_batches(spark)
    found = common.cut(neardup.grouped(docs, k=5, percent=80).where("doc_id is not null"))
    row = F.struct("doc_id", "print")
    linked = found.where("component is not null")
    gone = linked.join(linked.groupBy("component").agg(F.min(row).alias("best")), "component").where(row != F.col("best")).select("doc_id", "print").distinct()
    text, id_, print_ = _free(docs, "_text", "_id", "_print")
    left = _with(docs.withColumn(text, common.text_print()), text, gone, [id_, print_], "left_anti")
    repeated = found.groupBy("doc_id", "print").count().where("count > 1").select("doc_id", "print")
    if repeated.isEmpty():
        return left.select(docs.columns)
    once = _with(left, text, repeated, [id_, print_], "left_semi").dropDuplicates(["doc_id", text])
    return _with(left, text, repeated, [id_, print_], "left_anti").unionByName(once).select(docs.columns)


def private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    out = pii.replaced(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat, and documents that are not taken go.

    Rows are told apart by id, source and text; of rows that agree in these, one stands for all copies that are taken.
    """
    print_, id_, own, times, rows = _free(docs, "_print", "_id", "_own", "_times", "_rows")
    taken = mixing.mixed(docs).groupBy("doc_id", "print").agg(F.sum("times").cast("int").alias(times), F.count("*").alias(rows)).where(F.col(times) > 0)
    taken = common.cut(taken)
    marked = docs.withColumn(own, mixing.row_print())
    often = F.explode(F.array_repeat(F.lit(0), F.col(times)))
    out = _with(marked, own, taken.where(F.col(rows) == 1), [id_, print_], "inner").withColumn(times, often).select(docs.columns)
    repeated = taken.where(F.col(rows) > 1)
    if repeated.isEmpty():
        return out
    once = _with(marked, own, repeated, [id_, print_], "inner").dropDuplicates([id_, own])
    return out.unionByName(once.withColumn(times, often).select(docs.columns))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and a digest of the text they decode to: doc_id, source, n_tokens, ids, decoded_sha256."""
    common.small_batches(spark)
    coded = bpe.coded(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
