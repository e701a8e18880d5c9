"""URL filter: a trie over reversed host labels, then over path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.tables import slices

MAX_RULES = 200_000  # bound of what is broadcast; a longer list is refused

SCHEMA = "host string, path string, rule string, verdict string"


@dataclass
class Node:
    """A host label or path segment. ``ends`` holds (last partial segment, rule, verdict) of rules ending here."""

    hosts: dict[str, Node] = field(default_factory=dict)
    paths: dict[str, Node] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)


def build_trie(rules: Sequence[tuple[str, str]]) -> Node:
    """``rules``: (verdict, ``host/path``). The host covers its subdomains, the path is a prefix from ``/`` on."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are broadcast")
    root = Node()
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"bad rule {verdict} {rule}")
        node = root
        for label in reversed(ascii_lower(host).split(".")):
            node = node.hosts.setdefault(label, Node())
        *whole, rest = (slash + path).split("/") if slash else [""]
        for segment in whole:
            node = node.paths.setdefault(segment, Node())
        node.ends.append((rest, rule, verdict))
    return root


UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(UPPER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty for null and for urls without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return ascii_lower(host), slash + path


def judge(trie: Node, host: str, path: str, default: str) -> tuple[str | None, str]:
    """Longest fitting rule and its verdict. Of equally long rules the one with the longer host wins, then allow."""
    best: tuple[int, int, bool] | None = None
    rule, verdict = None, default
    node, depth, segments = trie, 0, path.split("/")
    for label in reversed(host.split(".")):
        node = node.hosts.get(label)
        if node is None:
            break
        depth += 1
        here = node
        for i in range(len(segments) + 1):
            rest = "/".join(segments[i:]) if here.ends else ""
            for prefix, text, says in here.ends:
                if rest.startswith(prefix) and (i < len(segments) or not prefix):
                    rank = (len(text), depth, says == "allow")
                    if best is None or rank > best:
                        best, rule, verdict = rank, text, says
            # The last segment has no slash after it, so no rule may pass through it.
            if i >= len(segments) - 1 or not (here := here.paths.get(segments[i])):
                break
    return rule, verdict


def filter_urls(
    df: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: id, host, path, the longest fitting rule (or null) and the verdict.

    Null or malformed urls have an empty host and path, fit no rule and get ``default``. Repeated
    rows are judged one by one; other columns are ignored. No shuffle: the trie goes to all tasks.
    """
    known = df.sparkSession.sparkContext.broadcast(build_trie(rules))
    kept = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = known.value
        for batch in slices(batches, 4096):
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            told = [judge(trie, h, p, default) for h, p in split]
            columns = [*zip(*[s + t for s, t in zip(split, told)])] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.string()) for c in columns]],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
