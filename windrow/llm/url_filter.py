"""URL rules as one bit-parallel automaton.

All glob patterns are laid side by side in one row of bits, as many 64-bit words as
they need. A bit is a position in a pattern; reading one character moves all
positions of all patterns at once::

    state = ((state << 1) & accepts[c]) | (state & stays[c])

``accepts[c]`` has the positions that the character leads into, ``stays[c]`` those that
a wildcard holds. ``?`` is one character, ``*`` any number of characters but ``/``,
``**`` any number of any characters. A pattern fits if its last position is set after the last
character. A batch of URLs advances in lockstep, one numpy step per character position;
finished URLs leave, so memory follows the batch and not the longest URL.

Rules are compiled on the driver (a few KB) and travel with the function.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` for a host with its subdomains and all paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> list[str]:
        return [f"{escaped(self.text)}**", f"*.{escaped(self.text)}**"]


def escaped(text: str) -> str:
    """``text`` as a glob that stands for itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def parsed(glob: str) -> list[str | None]:
    """Tokens of a glob: literals as ``=c``, ``?``, ``*`` and ``**``."""
    out, k = [], 0
    while k < len(glob):
        if glob[k] == "\\" and k + 1 < len(glob):
            out.append("=" + glob[k + 1])
            k += 2
        elif glob.startswith("**", k):
            out.append("**")
            k += 2
        elif glob[k] in "*?":
            out.append(glob[k])
            k += 1
        else:
            out.append("=" + glob[k])
            k += 1
    return out


@dataclass(frozen=True)
class Automaton:
    """Shift-And masks of several globs."""

    globs: tuple[str, ...]
    words: int = field(init=False, default=0)

    @cached_property
    def masks(self):
        """Alphabet, ``accepts`` and ``stays`` by character class, start and final positions."""
        tokens = [parsed(g) for g in self.globs]
        letters = sorted({t[1] for p in tokens for t in p if t[0] == "="} | {"/"})
        size = sum(1 + sum(t[0] == "=" or t == "?" for t in p) for p in tokens)
        words = max(1, -(-size // 64))
        # class 0 is every character that no pattern names
        accepts, stays = np.zeros((len(letters) + 1, words), np.uint64), np.zeros((len(letters) + 1, words), np.uint64)
        start, final, at = np.zeros(words, np.uint64), [], 0
        bit = lambda k: (k // 64, np.uint64(1) << np.uint64(k % 64))
        slash = letters.index("/") + 1
        for p in tokens:
            w, b = bit(at)
            start[w] |= b
            for t in p:
                w, b = bit(at)
                if t in ("*", "**"):
                    over_slash = (stays[slash, w] & b) != 0 or t == "**"
                    stays[:, w] |= b
                    if not over_slash:
                        stays[slash, w] &= ~b
                else:
                    at += 1
                    w, b = bit(at)
                    if t == "?":
                        accepts[:, w] |= b
                    else:
                        accepts[letters.index(t[1]) + 1, w] |= b
            final.append(bit(at))
            at += 1
        return letters, accepts, stays, start, final

    def fits(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: which text fits which glob as a whole."""
        letters, accepts, stays, start, final = self.masks
        n, words = len(texts), len(start)
        out = np.zeros((n, len(self.globs)), bool)
        if not n or not self.globs:
            return out
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        code = np.frombuffer("".join(texts[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.array([ord(c) for c in letters], np.uint32)
        spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
        kind = np.where(known[spot] == code, spot + 1, 0).astype(np.int32)
        state = np.tile(start, (n, 1))
        left = size[order]
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for k in range(int(left[0]) if n else 0):
            live = int(np.searchsorted(-left[:live], -k, side="left"))  # texts longer than k
            now, c = state[:live], kind[begin[:live] + k]
            moved = now << one
            if words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & accepts[c]) | (now & stays[c])
        for g, (w, b) in enumerate(final):
            out[order, g] = (state[:, w] & b) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def judged(host: Column, path: Column, rules: list[Rule], block_globs: list[str] = (), default: str = "allow") -> tuple[Column, Column]:
    """``rule`` (the longest one that fits, else null) and ``verdict`` of a canonical URL.

    Where no rule fits, ``block_globs`` over the canonical URL (host and path) decide: ``block`` if one
    fits, else ``default``. Equal rules with different actions: the first listed wins.
    """
    rules = sorted(rules, key=lambda r: -len(r.text))
    machine = Automaton(tuple(g for r in rules for g in r.globs) + tuple(block_globs))
    names = np.array([r.text for r in rules] + [None], object)
    actions = [r.action for r in rules]

    @F.pandas_udf("rule string, verdict string")
    def apply(canonical: pd.Series) -> pd.DataFrame:
        hit = machine.fits(canonical.tolist())
        by_rule = hit[:, : 2 * len(rules)].reshape(len(hit), len(rules), 2).any(axis=2)
        first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if rules else 0, len(rules))
        blocked = hit[:, 2 * len(rules) :].any(axis=1)
        verdict = np.array(actions + [default], object)[first]
        verdict[(first == len(rules)) & blocked] = "block"
        return pd.DataFrame({"rule": names[first], "verdict": verdict})

    out = apply(F.concat(host, path))
    return out["rule"], out["verdict"]


def filter_urls(pages: DataFrame, rules: list[Rule], block_globs: list[str] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    Cases: a null URL or one without ``://`` has an empty host and path, and fits no rule with a host;
    repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules, block_globs, default)
    return rows.select("page_id", "host", "path", F.struct(rule.alias("rule"), verdict.alias("verdict")).alias("_out")).select("page_id", "host", "path", "_out.rule", "_out.verdict")
