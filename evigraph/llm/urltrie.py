"""URL allow and block lists as a broadcast trie.

The trie runs over the labels of the host from the right and then over the path segments (each
with its closing slash); a rule whose path ends inside a segment keeps the rest as a prefix of
the next one. A rule fits its host and every subdomain if the url's path starts with its path.
Of the rules that fit, the longest (host and path together, then the longer host) decides.

A node finds the rest of a segment by one look-up for each length that its rules have, so many rules on one host cost no more
than a segment is long. The rules' bytes are summed before they are broadcast; beyond ``max_bytes`` the same answer comes from
equi-joins: host suffixes with the hosts of the rules, then path prefixes, of the lengths that this host's rules have, with the rules.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the
default verdict. Rules with a null host are dropped; a null path is the empty path. Of repeated
rules for one host and path ``block`` wins. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import staged


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: str) -> list[str]:
    parts = path.split("/")
    return [f"{p}/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class _Path:
    __slots__ = ("children", "ends", "lengths")

    def __init__(self) -> None:
        self.children: dict[str, _Path] = {}
        self.ends: dict[str, tuple[int, int, str, str]] = {}  # rest of a segment -> (length, host length, rule, verdict)
        self.lengths: list[int] = []  # of the rests, ascending


class _Host:
    __slots__ = ("children", "paths")

    def __init__(self) -> None:
        self.children: dict[str, _Host] = {}
        self.paths: _Path | None = None


class UrlTrie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        """rules: (verdict, host, path)"""
        self.root = _Host()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.children.setdefault(label, _Host())
            at = node.paths = node.paths or _Path()
            rest = ""
            for part in segments(path):
                if part.endswith("/"):
                    at = at.children.setdefault(part, _Path())
                else:
                    rest = part
            i = bisect_left(at.lengths, len(rest))
            if at.lengths[i : i + 1] != [len(rest)]:
                at.lengths.insert(i, len(rest))
            if at.ends.get(rest, ("",) * 4)[3] != "block":
                at.ends[rest] = (len(host) + len(path), len(host), host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node, parts = None, self.root, segments(path)
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            at, i = node.paths, 0
            while at is not None:
                nxt = parts[i] if i < len(parts) else ""
                for n in reversed(at.lengths[: bisect_right(at.lengths, len(nxt))]):
                    rule = at.ends.get(nxt[:n])
                    if rule:  # the longest of this node
                        best = rule if best is None else max(best, rule)
                        break
                at, i = at.children.get(nxt), i + 1
        return best and best[2:]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict. ``rules``: verdict, host, path."""
    split = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rules = rules.filter("host is not null").select("verdict", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    if (rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0) > max_bytes:
        return judge_by_join(split, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([trie.value.match(h, p) or (None, default) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return split.withColumn("r", look_up("host", "path")).select("page_id", "host", "path", "r.rule", "r.verdict")


def judge_by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule tables too large to broadcast: distinct (host, path) once, joined by key. Only suffixes with as few labels as
    the hosts of the rules have are made, and only prefixes of the lengths that the rules of the met host have."""
    urls = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    shallow = F.sequence(F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels))
    suffixes = F.transform(shallow, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    one = staged(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), "url-rules")
    hosts = one.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    met = urls.withColumn("rule_host", F.explode(suffixes)).join(hosts.hint("merge"), "rule_host")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = met.withColumn("rule_path", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n)))).drop("lengths")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = keys.join(one.hint("merge"), ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return split.join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
