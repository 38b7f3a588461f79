r"""URL filters: glob rules as one bit-parallel automaton over canonical URLs.

All rules are packed into the bits of a few 64-bit words (multiword Shift-And): a
character moves every active state of every rule by one shift and two masks.  The
URLs of a block run side by side, one array step for each position.

Canonical form: ``.`` + host + path.  Host: after the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.  A rule
``host/path`` is the glob ``*.host/path**``: ``*`` stands for any characters but ``/``,
``**`` for any at all, ``?`` for one that isn't ``/``; so it fits its host, all
subdomains, and every path that it begins.  The longest rule that fits decides (of
equally long ones, the earlier), and ``default`` where none does.

Null, and text without ``://``: host and path are empty, and no rule fits.  Repeated
rows are judged each; an empty table gives an empty table.  Other columns pass through;
one that has a result's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text
from ._spark import annotate

RESULTS = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str


#: Which crawl to keep: the production list
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def glob(pattern: str) -> list[tuple[int, int]]:
    """The glob's states (byte or -1 for any but /, loop: 0 none, 1 any but /, 2 any); state 0 is before all characters."""
    body = "*." + pattern + "**"
    states, i = [(-2, 0)], 0
    while i < len(body):
        if body.startswith("**", i):
            states[-1] = (states[-1][0], 2)
            i += 2
        elif body[i] == "*":
            states[-1] = (states[-1][0], max(1, states[-1][1]))
            i += 1
        else:
            states += [(-1, 0)] if body[i] == "?" else [(x, 0) for x in body[i].encode()]
            i += 1
    return states


class Automaton:
    """All rules' states packed into words; ``fits`` says which rules a string fits."""

    def __init__(self, patterns: list[str]) -> None:
        states = [glob(p) for p in patterns]
        n = sum(map(len, states))
        self.n_words = -(-n // 64)
        self.move = np.zeros((256, self.n_words), np.uint64)  # states that a byte may enter
        self.stay = np.zeros((256, self.n_words), np.uint64)  # states that a byte may stay in
        self.begin = np.zeros(self.n_words, np.uint64)
        self.accept = []
        bit = 0
        for own in states:
            for k, (byte, loop) in enumerate(own):
                w, mask = bit // 64, np.uint64(1 << bit % 64)
                if k == 0:
                    self.begin[w] |= mask
                elif byte >= 0:
                    self.move[byte, w] |= mask
                else:
                    self.move[:, w] |= mask
                    self.move[0x2F, w] &= ~mask
                if loop:
                    self.stay[:, w] |= mask
                    if loop == 1:
                        self.stay[0x2F, w] &= ~mask
                bit += 1
            self.accept.append(bit - 1)

    def fits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(strings, rules): simulates all rules over all strings, a position of every string a step."""
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = at[:-1][order], lengths[order]
        d = np.tile(self.begin, (len(order), 1))
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -i, "left"))  # those longer than i
            c = data[begins[:n] + i]
            x = d[:n]
            moved = x << np.uint64(1)
            moved[:, 1:] |= x[:, :-1] >> np.uint64(63)
            d[:n] = (moved & self.move[c]) | (x & self.stay[c])
        out = np.empty((len(order), len(self.accept)), bool)
        for r, bit in enumerate(self.accept):
            out[order, r] = (d[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            host, rest = rest[:i], rest[i:]
            break
    else:
        host, rest = rest, ""
    path = rest.partition("#")[0].partition("?")[0]
    return host.encode().translate(bytes(_text.LOWER)).decode(), path


def url_filters(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, the deciding rule and its verdict; one pass, no shuffle."""
    weight = np.array([len(r.pattern) for r in rules])
    names = pa.array([r.pattern for r in rules] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in rules] + [default], pa.string())
    automaton = Automaton([r.pattern for r in rules])

    def compute(block: pa.RecordBatch) -> list:
        parts = [split_url(x) for x in block.column(block.schema.get_field_index(url)).to_pylist()]
        has = np.array(["://" in (x or "") for x in block.column(block.schema.get_field_index(url)).to_pylist()], bool)
        data, at = _text.raw(pa.array([f".{h}{p}" for h, p in parts], pa.large_string()))
        fits = automaton.fits(data, at) & has[:, None]
        score = np.where(fits, weight, -1)
        best = score.argmax(axis=1) if len(rules) else np.zeros(len(parts), int)
        best = np.where(score.max(axis=1) >= 0, best, len(rules)) if len(rules) else np.zeros(len(parts), int)
        return [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), names.take(pa.array(best)), verdicts.take(pa.array(best))]

    return annotate(pages, RESULTS, compute, url, most=1 << 20)
