"""URL rules in a trie over reversed host labels and then the path, the deepest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import LOWER, UPPER

MAX_RULES = 1_000_000
PRODUCTION_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


class UrlTrie:
    """Nodes are dicts. Host labels are walked from the last; at each host node a second trie holds
    path segments. A rule's last segment may be a beginning only, so it is kept apart, by string."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for n, (host, path, verdict) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules; they would not fit a broadcast")
            if verdict not in ("allow", "block"):
                raise ValueError(verdict)
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            node["paths"] = at = node["paths"] or {"next": {}, "starts": {}}
            *whole, start = path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "starts": {}})
            old = at["starts"].get(start)
            if old is None or verdict == "block":  # the same rule twice: block wins
                at["starts"][start] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of the most host labels, then of the longest path, or None."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"]:
                found = self._path(node["paths"], path) or found
        return found

    @staticmethod
    def _path(at: dict, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            fits = [s for s in at["starts"] if segment.startswith(s)] if len(at["starts"]) < 8 else [segment[:k] for k in range(len(segment) + 1) if segment[:k] in at["starts"]]
            if fits:
                found = at["starts"][max(fits, key=len)]
            at = at["next"].get(segment)
            if at is None:
                break
        return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Host and path are cut in the JVM: a url that is null or lacks ``://`` has both empty. A rule
    (host, path, verdict) fits its host and all subdomains where the path starts with the rule's.
    The match with most host labels wins, then that with the longest path; a rule given as both
    allow and block blocks. Without a match the verdict is ``default`` and the rule null. Only the
    trie (up to MAX_RULES rules) is broadcast. Repeated rows are judged each; no shuffle.
    """
    trie = ship(pages.sparkSession).sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = trie.value
        for host, path in parts:
            yield pd.DataFrame([t.match(h, p) or (None, default) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    start = F.instr(F.col("url"), "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    cut = pages.select(
        "page_id",
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return cut.withColumn("_j", look("host", "path")).select("page_id", "host", "path", "_j.rule", "_j.verdict")
