"""URL filter: host and path rules, then a weighted vocabulary.

An Aho-Corasick automaton finds strict and soft terms in the lower-cased url in
one pass.  A hit counts when it is not part of a longer run of letters and
digits.  One strict hit, or soft hits of several different terms, reject the url.
A rule that fits decides before the vocabulary: a rule covers its host and all
subdomains when the url's path starts with the rule's; the longest wins.

Defined results: a null url, or one without ``://``, has an empty host and path,
so no rule fits; a null url has no terms and is allowed; repeated rows are judged
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import lower_ascii
from matloom.llm.registry import query

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Terms that reject alone, and terms of which several are needed.
STRICT = ("casino", "porn", "xxx", "viagra", "pills", "warez", "spam")
SOFT = ("adult", "bet", "bonus", "cheap", "deal", "farm", "free", "jackpot", "loan", "poker", "prize", "win")
SOFT_NEEDED = 2
#: Characters that go on a word: ASCII letters and digits, as a url spells others by escapes.
INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``verdict|host/path`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.lit(f"{verdict}|{domain}{start}")).otherwise(out)
    return out


def count_terms(urls: DataFrame, strict: tuple = STRICT, soft: tuple = SOFT) -> DataFrame:
    """Add ``n_strict`` and ``n_soft``, the distinct terms found in ``url``."""
    columns = [c for c in urls.columns if c not in ("n_strict", "n_soft")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, terms in ((0, strict), (1, soft)):
            for t in terms:
                automaton.add_word(t.lower(), (kind, t.lower()))
        automaton.make_automaton()
        for batch in batches:
            found = ([], [])
            for url in batch.column("url").to_pylist():
                hits: tuple[set, set] = (set(), set())
                low = (url or "").lower()
                for end, (kind, term) in automaton.iter(low):
                    begin = end - len(term)
                    if not ((begin >= 0 and low[begin] in INSIDE) or low[end + 1 : end + 2] in INSIDE):
                        hits[kind].add(term)
                for kind in (0, 1):
                    found[kind].append(len(hits[kind]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(x, pa.int32()) for x in found)],
                [*columns, "n_strict", "n_soft"],
            )

    rows = urls.select(*columns)
    return rows.mapInArrow(scan, copy(rows.schema).add("n_strict", "integer").add("n_soft", "integer"))


def judge(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """``(page_id, host, path, rule, verdict, n_strict, n_soft)`` of every row."""
    counted = count_terms(pages.select("page_id", "url"), strict, soft)
    host, path = host_and_path(F.col("url"))
    ruled = counted.select("page_id", host.alias("host"), path.alias("path"), "n_strict", "n_soft")
    ruled = ruled.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_needed), "block").otherwise("allow")
    return ruled.select(
        "page_id",
        "host",
        "path",
        F.substring_index("_rule", "|", -1).alias("rule"),
        F.coalesce(F.substring_index("_rule", "|", 1), by_terms).alias("verdict"),
        "n_strict",
        "n_soft",
    )


def _sql() -> str:
    def hits(terms):
        words = ", ".join(f"'{t}'" for t in terms)
        return f"CAST(len(list_filter([{words}], lambda t: regexp_matches(low, '(^|[^[:alnum:]])' || t || '($|[^[:alnum:]])'))) AS INTEGER)"

    def rule(field):
        out = "NULL"
        for verdict, domain, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
            value = verdict if field == "verdict" else domain + start
            out = f"CASE WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}') THEN '{value}' ELSE {out} END"
        return out

    return f"""
WITH u AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), t AS (
  SELECT page_id, host, path, {hits(STRICT)} AS n_strict, {hits(SOFT)} AS n_soft FROM h
)
SELECT page_id, host, path, {rule("rule")} AS rule,
       coalesce({rule("verdict")}, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM t"""


@query("op9_url_filter", _sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
