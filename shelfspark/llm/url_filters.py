"""URL rules by a bit-parallel wildcard automaton.

Every glob is a chain of byte classes; all chains lie end to end in the bits of a few
64-bit words. One step of Shift-And moves all of them over one byte of the URL: shift,
carry between words, mask by the byte, and keep the states whose star takes the byte.
A task runs a whole batch of URLs in step, longest first, and drops those whose answer
can no longer change. No shuffle: URLs meet only the rules, which are job settings.

Glob syntax: ``?`` one byte but ``/``; ``*`` any run without ``/``; ``**`` any run; all
else is itself. A glob has to fit the whole canonical URL, host followed by path.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


class Automaton:
    """All ``globs`` as multiword Shift-And masks."""

    def __init__(self, globs: list[str]):
        chains = [self._parse(g) for g in globs]
        bits = sum(len(c) + 1 for c, _ in chains)
        self.words = max(1, -(-bits // 64))
        self.move = np.zeros((256, self.words), dtype=U64)
        self.stay = np.zeros((256, self.words), dtype=U64)
        self.start = np.zeros(self.words, dtype=U64)
        self.ends: list[tuple[int, U64]] = []
        at = 0
        for classes, stars in chains:
            self._set(self.start, at)
            for i, accepted in enumerate(classes):
                for byte in accepted:
                    self._set(self.move[byte], at + i + 1)
            for i, taken in stars.items():
                for byte in taken:
                    self._set(self.stay[byte], at + i)
            at += len(classes)
            self.ends.append((at // 64, U64(1 << (at % 64))))
            at += 1
        # States that never leave: an end behind a star that takes any byte.
        self.settled = np.bitwise_and.reduce(self.stay, axis=0)
        final = np.zeros(self.words, dtype=U64)
        for w, bit in self.ends:
            final[w] |= bit
        self.settled &= final

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= U64(1 << (bit % 64))

    @staticmethod
    def _parse(glob: str) -> tuple[list[list[int]], dict[int, list[int]]]:
        """Byte classes of the chain, and the bytes taken by the star that follows each count of them."""
        every, inner = list(range(256)), [b for b in range(256) if b != ord("/")]
        classes: list[list[int]] = []
        stars: dict[int, list[int]] = {}
        raw = glob.encode()
        i = 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                stars[len(classes)] = every
                i += 2
                continue
            if raw[i : i + 1] == b"*":
                stars.setdefault(len(classes), inner)
            else:
                classes.append(inner if raw[i : i + 1] == b"?" else [raw[i]])
            i += 1
        return classes, stars

    def run(self, urls: list[bytes]) -> np.ndarray:
        """End states (urls, words) after each whole URL."""
        out = np.zeros((len(urls), self.words), dtype=U64)
        lengths = np.fromiter(map(len, urls), dtype=np.int64, count=len(urls))
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(urls), dtype=np.uint8)
        base = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        step = 0
        while len(order):
            live = int(np.searchsorted(-left, -step, "left"))  # URLs with a byte at this step
            if live < len(order):
                out[order[live:]] = state[live:]
                order, base, left, state = order[:live], base[:live], left[:live], state[:live]
                if not live:
                    break
            byte = raw[base + step]
            moved = state << U64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> U64(63)
            state = (moved & self.move[byte]) | (state & self.stay[byte])
            step += 1
            if step % 32 == 0:
                done = ~(state & ~self.settled).any(axis=1)
                if done.any():
                    out[order[done]] = state[done]
                    order, base, left, state = order[~done], base[~done], left[~done], state[~done]
        return out

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """(urls, globs): which globs fit each whole URL."""
        ends = self.run(urls)
        return np.stack([(ends[:, w] & bit) != 0 for w, bit in self.ends], axis=1) if self.ends else np.zeros((len(urls), 0), bool)


def split_url(pages: DataFrame, *more: str) -> DataFrame:
    """host (A-Z lower-cased) and path of ``url``; null or without ``://``: both empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select(*more, F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    rows = rows.select(*more, "_rest", host.alias("_host"))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return rows.select(*more, F.translate("_host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), path.alias("path"))


def _judge(rules: list[Rule], block_globs: list[str], default: str):
    ranked = sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block"), reverse=True)
    globs = [g for r in ranked for g in r.globs()] + block_globs
    names = np.array([r.name for r in ranked] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in ranked] + [default, "block"], dtype=object)
    machine = Automaton(globs)

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            urls = [(h + p).encode("utf-8", "surrogatepass") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            fit = machine.fits(urls)
            ruled = fit[:, : 2 * len(ranked)].reshape(len(urls), len(ranked), 2).any(axis=2)
            ruled = np.concatenate([ruled, np.ones((len(urls), 1), dtype=bool)], axis=1)
            best = ruled.argmax(axis=1)
            caught = (best == len(ranked)) & fit[:, 2 * len(ranked) :].any(axis=1)
            verdict = np.where(caught, "block", verdicts[best])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return rows


def filter_urls(pages: DataFrame, rules: list[Rule], block_globs: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    The longest rule (host and path together; ties: the longer host, then block) that
    fits decides. Where none does, rule is null and the verdict is block if one of
    ``block_globs`` fits, else ``default``. A null url or one without ``://`` has empty
    host and path and fits no rule. Repeated rows are judged each; other columns are
    ignored. URLs of any length are read to their end.
    """
    rows = split_url(pages, "page_id")
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_judge(list(rules), list(block_globs), default), f"page_id {kind}, host string, path string, rule string, verdict string")
