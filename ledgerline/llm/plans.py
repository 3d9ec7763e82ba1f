"""The queries p6 to p8 over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, read
from . import leakage, lookalike, mixing
from .lookalike import IGNORABLE, same_look


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_removal_spans(spark: SparkSession, d: str) -> DataFrame:
    """Per document that carries items these and the ranges of characters to remove."""
    return leakage.removals(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p6_item_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item in how many documents it leaked; items that did not have 0."""
    items = read(spark, d, "eval_items")
    n = p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "task", "split").join(n, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets")).selection()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets")).report()


def p7_report_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The report where each mix is asked to have as many tokens as all documents: sources that can't give their share are told."""
    docs, mixes = read(spark, d, "documents"), read(spark, d, "mix_targets")
    return mixing.Mixture(docs, mixes, total=mixing.ALL).report()


def _digests(spark: SparkSession, d: str) -> DataFrame:
    return materialize(lookalike.digests(read(spark, d, "documents")), "looks")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_digests(spark, d))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document of a class of the same look with several different texts."""
    return lookalike.classes(_digests(spark, d)).select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"), "texts")


def p8_change_report(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.change_report(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_removal_spans, p6_item_report, p7_selection, p7_report, p7_report_of_all, p8_found, p8_classes, p8_change_report)}


def _table() -> dict[str, str]:
    """Signs whose form is another one, outside of what can't be seen, from the rule for one sign."""
    out = {}
    for a, z in ((0x80, 0x3400), (0xA4D0, 0xA500), (0xAB70, 0xABC0), (0xF900, 0xFFF0)):
        for n in range(a, z):
            c = chr(n)
            form = "" if any(i <= n <= j for i, j in IGNORABLE) else same_look(c)
            if form and form != c:
                out[c] = form
    return out


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _forms_sql() -> str:
    """d (doc_id, lang, text, form): a sign by sign replacement, then canonical composition."""
    table = _table()
    single = {a: b for a, b in table.items() if len(b) == 1}
    gone = "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in IGNORABLE)
    t = f"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[{gone}]', '', 'g')"
    t = f"regexp_replace(translate({t}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))}), '[\\x{{0}}-\\x{{8}}\\x{{E}}-\\x{{1F}}\\x{{7F}}]', '', 'g')"
    t = f"translate({t}, chr(9) || chr(11) || chr(12) || chr(13) || chr(133) || chr(8232) || chr(8233), ' ' || repeat(chr(10), 6))"
    many = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in table.items() if len(b) > 1)
    return f"""many as (select map(list(a), list(b)) m from (values {many}) v(a, b)),
t as (select doc_id, lang, text, {t} as x from documents where text is not null),
d as (select doc_id, lang, text, nfc_normalize(array_to_string(list_transform(string_split(x, ''), lambda c: coalesce(m[c], c)), '')) as form from t, many)"""


_D = _forms_sql()
SQL: dict[str, str] = {
    "p8_found": f"with {_D} select a.doc_id as doc_a, b.doc_id as doc_b from d a join d b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id",
    "p8_classes": f"""with {_D}, c as (select form, cast(count(distinct text) as bigint) as texts, min(doc_id) as class_id from d group by form having count(distinct text) > 1)
select doc_id, class_id, texts from d join c on c.form = d.form""",
    "p8_change_report": f"with {_D} select o.lang, cast(count(*) as bigint) as n_docs, cast(sum(case when d.form <> d.text then 1 else 0 end) as bigint) as n_changed from documents o left join d on d.doc_id = o.doc_id group by o.lang",
}
