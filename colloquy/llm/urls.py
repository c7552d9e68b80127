"""Verdicts on URLs: longest-match rules on host and path, and association rules mined by FP-growth for what they leave open.

URLs that a rule fits are labelled by it. Spark's FP-growth mines combinations of their tokens together with the label;
combinations that name a label often and surely enough stay as association rules. These are posted in an inverted index
under one of their tokens, the rarest, so that a URL meets only rules with a token of its own; the surest rule whose tokens
it has all decides. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch

#: (verdict, host, beginning of the path)
Rule = tuple[str, str, str]
ALLOW, BLOCK = "allow", "block"
#: Marks the label among the tokens; no token begins so.
LABEL = "="
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z as a-z; empty for null or without one."""
    return F.coalesce(F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(verdict, rule) of the longest rule whose host is the host or a parent domain and whose path the path starts with.

    Of rules of one length the one with the longer host wins, then the smaller text. At most ``MOST_RULES`` rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, domain, begins in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(begins)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + begins).alias("rule"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """At most nine distinct tokens: one for each place of a URL, so that no URL has more than 2**9 combinations.

    The host, its last two labels, its last and its first one, the first and the second part of the path, how the path ends,
    the number of its parts, and the names of the query's parameters. In parts of the path, digits count as one ``#``.
    """
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    part = lambda k: F.regexp_replace(F.get(parts, F.lit(k)), "[0-9]+", "#")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))))
    places = {
        "host": host,
        "site": F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "top": F.element_at(labels, -1),
        "sub": F.when(F.size(labels) > 2, F.element_at(labels, 1)),
        "first": part(0),
        "second": part(1),
        "ending": F.when(path.endswith("/"), "/").otherwise(F.regexp_extract(path, r"\.[A-Za-z0-9]{1,8}$", 0)),
        "parts": F.size(parts).cast("string"),
        "query": F.array_join(F.filter(names, lambda n: n != ""), "&"),
    }
    return F.array_compact(F.array(*(F.when(value != "", F.concat(F.lit(f"{place}:"), value)) for place, value in places.items())))


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = 0.02, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, label, hits, seen, posted) from rows (tokens, label): combinations of tokens that come with ``label`` in
    ``hits`` of ``seen`` rows.

    A combination with its label is in the share ``min_support`` of the rows at least, and the label in the share
    ``min_confidence`` of the combination's. ``posted`` is the combination's rarest token (ties: the smallest). Tokens don't
    begin with ``LABEL``. Rows without label are left out.
    """
    items = labelled.where("label is not null").select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mined = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=tasks).fit(items).freqItemsets
    is_label = lambda x: x.startswith(LABEL)
    sets = scratch.save(mined.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.filter("items", is_label).alias("labels"), "freq"), "itemsets").where(F.size("tokens") > 0)
    seen = sets.where(F.size("labels") == 0).select("tokens", F.col("freq").alias("seen"))
    hits = sets.where(F.size("labels") == 1).select("tokens", F.substring(F.col("labels")[0], len(LABEL) + 1, 1 << 30).alias("label"), F.col("freq").alias("hits"))
    sure = hits.join(seen, "tokens").where(F.col("hits") / F.col("seen") >= min_confidence)
    single = seen.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("seen").alias("rows"))
    rarest = sure.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min(F.struct("rows", "token")).alias("r"))
    return sure.join(rarest, "tokens").select("tokens", "label", "hits", "seen", F.col("r.token").alias("posted"))


def surest(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, label) for each distinct row (tokens) that holds all tokens of a mined rule: the label of the rule with the
    highest confidence; ties go to more hits, then fewer tokens, then the smaller tokens and label.

    The index is joined by one token of each rule; a row meets the rules posted under its own tokens, and those whose other
    tokens it has too stay.
    """
    index = rules.select(F.col("posted").alias("token"), F.col("tokens").alias("wanted"), "label", (F.col("hits") / F.col("seen")).alias("confidence"), "hits")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("wanted", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("hits")).alias("h"), F.size("wanted").alias("s"), F.col("wanted").alias("w"), "label")
    return met.groupBy("tokens").agg(F.min(rank).alias("best")).select("tokens", F.col("best.label").alias("label"))


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, min_support: float = 0.02, min_confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    The longest fitting rule decides. Association rules are mined from the URLs that a rule fits, with its verdict, or from
    ``labels`` (url, label); they decide for the other URLs, the surest one first, and where none of them holds either, the
    label that most labelled URLs have (ties: the smaller; without any: allow). Null URLs and such without ``://`` have an
    empty host and path and no rule. Repeated rows and null ids are kept; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = pages[url_col].cast("string")
    parsed = pages.select(pages[id_col].alias("page_id"), url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fitted = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    if labels is None:
        labelled = fitted.where("fit is not null").select(tokens, F.col("fit.verdict").alias("label"))
    else:
        told = labels.select(labels["url"].cast("string").alias("url"), labels["label"].alias("label"))
        labelled = told.select("label", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(tokens, "label")
    usual = labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
    settled = fitted.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict")
    open_rows = fitted.where("fit is null").select("page_id", "host", "path", tokens)
    if usual is None:
        return settled.unionByName(open_rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict")))
    mined = scratch.save(mine(labelled, scratch, min_support, min_confidence), "rules")
    decided = scratch.save(surest(open_rows.select("tokens").distinct(), mined), "decided")
    found = open_rows.join(decided, "tokens", "left")
    return settled.unionByName(found.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("label", F.lit(usual["label"])).alias("verdict")))
