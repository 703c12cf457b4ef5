"""URL filtering: host rules by longest match, pattern rules indexed by their rarest literal token.

Everything is a DataFrame expression; no Python runs on executors.

Pattern rules use the common filter-list syntax: ``||`` anchors at a host label, ``|`` at the start
or end, ``^`` stands for a separator or the end, ``*`` for anything, and a leading ``@@`` makes an
exception. A literal token of a rule is a run of letters and digits that must appear in a URL as a
whole token. Each rule is filed under the token that is rarest over all URLs of the table; the tokens of the
distinct URLs are joined to the filed rules, and only such candidates run their regular expression. Rules
without a literal token are candidates of every URL; they are expressions of the plan.

Rules are tables, so there may be any number of them; they are broadcast as long as their counted size allows.
Host rules meet the distinct hosts by the hosts' own tails.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm.common import ascii_lower
from glossmark.session import join_bounded, stage

_TOKEN = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for a null or odd URL."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def regex_of(pattern: str) -> str:
    """The regular expression of one pattern rule, for a lower-cased URL."""
    body = pattern.removeprefix("@@").lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    special = {"*": ".*", "^": r"([^a-z0-9_.%\-]|$)"}
    return head + "".join(special.get(c) or (c if re.fullmatch("[a-z0-9]", c) else rf"\x{ord(c):02x}" if ord(c) < 256 else c) for c in body) + tail


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every URL matched by ``pattern`` has: runs with a literal non-token sign or an anchor at both ends."""
    body = pattern.removeprefix("@@").lower()
    anchored_end = body.endswith("|") and not body == "||"
    opened = body.startswith("|")
    body = body.lstrip("|").removesuffix("|")
    found = set()
    for m in re.finditer(_TOKEN, body):
        before = body[m.start() - 1] if m.start() else ("|" if opened else "*")
        after = body[m.end()] if m.end() < len(body) else ("|" if anchored_end else "*")
        if before != "*" and after != "*":
            found.add(m.group())
    return found


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(f"({_TOKEN})"), F.lit(1)))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Given rows as a staged table."""
    return stage(spark.createDataFrame(rows, schema), "url-rules")


def rule_index(urls: DataFrame, patterns: list[str]) -> DataFrame:
    """``t``, ``pattern``, ``regex``, ``excepts``: the rules with a literal token, each under its rarest one, staged.

    ``urls`` has the distinct lower-cased URLs as ``u``, whose tokens are all counted; of equally rare tokens the
    one that sorts first is taken.
    """
    spark = urls.sparkSession
    texts = list(dict.fromkeys(patterns))
    tokens = [(i, t) for i, p in enumerate(texts) for t in sorted(literal_tokens(p))]
    rules = _table(spark, [(i, p, regex_of(p), p.startswith("@@")) for i, p in enumerate(texts)], "no long, pattern string, regex string, excepts boolean")
    owned = _table(spark, tokens, "no long, t string")
    seen = join_bounded(urls.select(F.explode(tokens_of(F.col("u"))).alias("t")), owned.select("t").distinct(), ["t"])
    counts = seen.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rarest = owned.join(counts, "t", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("x"))
    return stage(rules.join(rarest.select("no", F.col("x.t").alias("t")), "no").drop("no"), "url-index")


def pattern_matches(df: DataFrame, url: str, patterns: list[str]) -> DataFrame:
    """``u`` (a lower-cased URL) and ``filed``: the rules (pattern, excepts) with a literal token that match it; staged."""
    urls = stage(df.select(F.lower(F.col(f"`{url}`")).alias("u")).where("u IS NOT NULL").distinct(), "urls")
    index = rule_index(urls, patterns)
    tokens = urls.select("u", F.explode(tokens_of(F.col("u"))).alias("t"))
    found = join_bounded(tokens, index, ["t"], staged=True).where(F.regexp_like("u", F.col("regex")))
    return stage(found.groupBy("u").agg(F.array_sort(F.collect_set(F.struct("pattern", "excepts"))).alias("filed")), "url-matches")


def _unfiled(url: Column, patterns: list[str]) -> Column:
    """The rules without a literal token that match a lower-cased URL."""
    found = [
        F.when(F.coalesce(F.regexp_like(url, F.lit(regex_of(p))), F.lit(False)), F.struct(F.lit(p).alias("pattern"), F.lit(p.startswith("@@")).alias("excepts")))
        for p in dict.fromkeys(patterns) if not literal_tokens(p)
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<pattern:string,excepts:boolean>>")


def host_rules(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host`` and ``known``: the rules (size, rule, verdict, path) of a host and the hosts it belongs to; staged."""
    table = _table(
        hosts.sparkSession, [(h, len(h + p), h + p, v, p) for h, p, v in dict.fromkeys(rules)], "tail string, size int, rule string, verdict string, path string"
    )
    labels = F.split("host", r"\.")
    tails = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("tail"))
    found = join_bounded(tails, table, ["tail"], staged=True)
    return stage(found.groupBy("host").agg(F.collect_list(F.struct("size", "rule", "verdict", "path")).alias("known")), "host-rules")


def judge(df: DataFrame, url: str, rules: list[tuple[str, str, str]], patterns: list[str]) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``patterns`` (those that matched, sorted).

    A host rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's path; the longest
    fitting rule decides, of two of one length the one that sorts last. Without one the URL is blocked if a pattern matches and
    no exception does. A null URL has empty host and path and is allowed. An empty table gives no rows. Columns of ``df`` with the
    names of the outputs, but for case, are replaced. Rows are judged alone: repeated rows get equal verdicts.
    """
    outputs = ("host", "path", "rule", "verdict", "patterns")
    kept = [c for c in df.columns if c.lower() not in outputs]
    source = F.col(f"`{url}`")
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lower(source).alias("u"),
        host_of(F.coalesce(source, F.lit(""))).alias("host"), path_of(F.coalesce(source, F.lit(""))).alias("path"),
    )
    known = host_rules(rows.select("host").where("host != ''").distinct(), rules)
    rows = join_bounded(rows, known, ["host"], "left", staged=True)
    rows = join_bounded(rows, pattern_matches(df, url, patterns), ["u"], "left", staged=True)
    fits = F.filter("known", lambda r: F.col("path").startswith(r["path"]))
    fit = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))
    nothing = F.array().cast("array<struct<pattern:string,excepts:boolean>>")
    hits = F.array_sort(F.concat(F.coalesce("filed", nothing), _unfiled(F.col("u"), patterns)))
    rows = rows.withColumn("fit", fit).withColumn("hits", hits)
    blocked = F.exists("hits", lambda r: ~r["excepts"]) & ~F.exists("hits", lambda r: r["excepts"])
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("hits.pattern").alias("patterns"),
    )
