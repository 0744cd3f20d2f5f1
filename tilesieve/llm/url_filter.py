"""URL filters: a memory-mapped sorted digest array of rules.

The rules are laid out once in one file: sorted 64-bit xxhash digests of the
rule hosts and of the whole rules, and the rule strings themselves. Spark ships
the file to every executor, whose Python workers memory-map it, so its pages are
shared by all workers of a machine and a list of many millions of rules costs no
heap. A batch of urls is probed with vectorised binary searches: first every
host suffix against the host digests, then the few (suffix, path prefix)
combinations that remain against the rule digests. Every digest hit is confirmed
against the stored string, so a collision can never give a verdict.

A rule ``host/path`` fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule wins. A rule given both ways blocks.

Edge cases: null urls, empty urls and urls without ``://`` have an empty host
and path and get the default verdict; repeated rows are judged each by itself;
ties cannot arise, as two rules that fit one url differ in length; very long urls
cost as much as the rules have labels, not as they have themselves;
an empty table gives no rows; an empty rule list gives every url the default;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesieve.llm.common import map_rows
from tilesieve.plans.shared import shared_dir, write_bytes

VERDICTS = ("allow", "block")
MAX_RULES = 100_000_000  # the driver lays the file out; a longer list is refused


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a url; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def suffixes(host: str, counts: list[int]) -> list[str]:
    """The host and its parent domains of as many labels as the counts (ascending) say: so
    many at most as rules differ in labels, however many labels a host has."""
    out, at, labels = [], len(host), 0
    for n in counts:
        while labels < n and at >= 0:
            at = host.rfind(".", 0, at)
            labels += 1
        if labels < n:
            break
        out.append(host[at + 1 :])
    return out


def _digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def _sorted_strings(strings: list[bytes], digest=_digests) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    d = digest(strings)
    order = np.argsort(d, kind="stable")
    ends = np.zeros(len(strings) + 1, np.int64)
    ends[1:] = np.cumsum([len(strings[i]) for i in order])
    return d[order], ends, b"".join(strings[i] for i in order), order


def build_index(rules: Iterable[tuple[str, str]], digest=_digests) -> bytes:
    """The index file of ``(rule, verdict)`` pairs: ten NumPy arrays, one after another."""
    chosen: dict[str, int] = {}
    for rule, verdict in rules:
        chosen[rule] = max(chosen.get(rule, 0), VERDICTS.index(verdict))
        if len(chosen) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
    names = list(chosen)
    lengths: dict[str, set[int]] = {}
    for rule in names:
        host, path = split_rule(rule)
        lengths.setdefault(host, set()).add(len(path))
    hosts = list(lengths)
    hd, he, hs, order = _sorted_strings([h.encode() for h in hosts], digest)
    paths = [sorted(lengths[hosts[i]]) for i in order]
    first = np.zeros(len(hosts) + 1, np.int64)
    first[1:] = np.cumsum([len(p) for p in paths])
    rd, re_, rs, order = _sorted_strings([r.encode() for r in names], digest)
    arrays = [hd, he, np.frombuffer(hs, np.uint8), first, np.array([x for p in paths for x in p], np.int64), rd, re_, np.frombuffer(rs, np.uint8), np.array([chosen[names[i]] for i in order], np.uint8)]
    arrays.append(np.array(sorted({h.count(".") + 1 for h in hosts}), np.int64))
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64)
    out = io.BytesIO()
    out.write(head.tobytes())
    for a in arrays:
        out.write(b"\0" * (-out.tell() % 8))
        out.write(a.tobytes())
    return out.getvalue()


KINDS = (np.uint64, np.int64, np.uint8, np.int64, np.int64, np.uint64, np.int64, np.uint8, np.uint8, np.int64)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str, digest=_digests):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        sizes = data[8 : 8 * (n + 1)].view(np.int64)
        at, arrays = 8 * (n + 1), []
        for size, kind in zip(sizes, KINDS, strict=True):
            at += -at % 8
            arrays.append(data[at : at + int(size)].view(kind))
            at += int(size)
        self.hosts, self.host_ends, self.host_text, self.first, self.lengths, self.rules, self.rule_ends, self.rule_text, self.verdicts, labels = arrays
        self.labels = labels.tolist()
        self.digest = digest

    @staticmethod
    def _found(keys: np.ndarray, ends: np.ndarray, text: np.ndarray, wanted: list[bytes], digests: np.ndarray) -> Iterable[tuple[int, int]]:
        """(position in ``wanted``, position in the index) of confirmed strings."""
        low = np.searchsorted(keys, digests, "left")
        high = np.searchsorted(keys, digests, "right")
        for i in np.flatnonzero(high > low).tolist():
            for k in range(int(low[i]), int(high[i])):
                if text[ends[k] : ends[k + 1]].tobytes() == wanted[i]:
                    yield i, k

    def judge(self, places: list[tuple[str, str]]) -> tuple[list[str | None], list[int | None]]:
        """The winning rule and its verdict for each (host, path)."""
        asked, row = [], []
        for i, (host, _) in enumerate(places):
            for s in suffixes(host, self.labels) if host else ():
                asked.append(s.encode("utf-8", "surrogatepass"))
                row.append(i)
        keys, owner = [], []
        for i, k in self._found(self.hosts, self.host_ends, self.host_text, asked, self.digest(asked)):
            path = places[row[i]][1]
            for n in self.lengths[self.first[k] : self.first[k + 1]].tolist():
                if n <= len(path):
                    keys.append(asked[i] + path[:n].encode("utf-8", "surrogatepass"))
                    owner.append((row[i], len(asked[i])))
        best: list = [None] * len(places)
        for i, k in self._found(self.rules, self.rule_ends, self.rule_text, keys, self.digest(keys)):
            at, host_size = owner[i]
            rank = (len(keys[i].decode("utf-8", "surrogatepass")), host_size)
            if best[at] is None or rank > best[at][0]:
                best[at] = (rank, keys[i].decode("utf-8", "surrogatepass"), int(self.verdicts[k]))
        return [b and b[1] for b in best], [b and b[2] for b in best]


def ship_index(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the index to the shared folder and have Spark send it to every executor."""
    data = build_index(rules)
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = f"{shared_dir(spark)}/tilesieve/{name}"
    write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return name


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row."""
    name = ship_index(pages.sparkSession, rules)
    frame = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))

    def start():
        from pyspark import SparkFiles

        index = Index(SparkFiles.get(name))

        def step(ids, urls):
            places = [split_url(u) for u in urls]
            rule, verdict = index.judge(places)
            return [ids, [p[0] for p in places], [p[1] for p in places], rule, [default if v is None else VERDICTS[v] for v in verdict]]

        return step

    return map_rows(frame, "id bigint, host string, path string, rule string, verdict string", start).withColumnRenamed("id", id_col)
