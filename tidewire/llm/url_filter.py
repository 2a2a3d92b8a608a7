"""URL filters: a bit-parallel wildcard automaton runs all glob rules at once over each canonical URL.

Every rule is a glob over symbols: characters of the canonical URL, `?` for any one symbol, `*` for any run. A rule of m symbols
other than `*` owns m + 1 consecutive bits, its states; all rules' bits are packed into 64-bit words. One step on symbol c is

    D = (((D << 1) & B[c]) | (D & S))

with the carry from word to word, B[c] the states that c leads into and S the states where a `*` loops. A rule matches if its last
state is set at the end. A batch of URLs is stepped together, one column of symbols at a time, so numpy does all rules of all URLs
of the batch per step; columns are laid out COLUMNS at a time for the URLs that are that long, and the last few, very long ones go
on alone as whole integers.

Rules of any number are packed into machines of about MACHINE_WORDS words each, put together by the last label of their hosts; a URL goes
through the machines that hold rules for its own label, or for any. URLs are stepped in slices of STATE_BYTES of states at most, so
memory is that, besides some bytes per symbol of a batch and the masks, whatever the number of rules or the longest URL.

The canonical URL of the host rules is "." + host + END + path: END is a symbol that no URL can hold, so `*` can't slip from the
host into the path, and the leading dot makes `*.net` fit the domain itself and its subdomains alike.

Cases: a null URL, or one without "://", has empty host and path and fits no rule; of the rules that fit, the one with most
literal symbols wins, ties to the first given; no rule: verdict default. No shuffle, no state between rows. Compiled rules go to executors as a
broadcast, whose size is that of the rules given: a few hundred bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ship

#: The symbol between host and path; beyond every code point.
END = 0x110000
#: Words of a machine's masks, about, and bytes of the states of URLs that are stepped together, at most.
MACHINE_WORDS, STATE_BYTES = 256, 32 << 20
#: Columns of symbols that are laid out at a time, and the number of URLs left from which each goes on alone.
COLUMNS, FEW = 512, 8


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with path; host and path may hold `*` and `?`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[int | None | str]:
        """Code points; None is any one symbol, "*" any run."""
        one = lambda c: "*" if c == "*" else None if c == "?" else ord(c)
        return ["*", ord("."), *map(one, self.host), END, *map(one, self.path), "*"]


@dataclass
class Automaton:
    """Packed Shift-And masks of all rules."""

    names: list[str]
    verdicts: list[str]
    order: np.ndarray  # rule numbers, the strongest first
    first: np.ndarray  # words with the first states
    loops: np.ndarray
    finals: np.ndarray  # bit number of each rule's last state
    into: np.ndarray  # [symbol class, word]
    classes: dict[int, int] = field(default_factory=dict)  # code point -> row of `into`; others use row 0

    def step_all(self, texts: list[str]) -> np.ndarray:
        """For each canonical URL the number of the winning rule, or -1."""
        n = len(texts)
        won = np.full(n, -1, dtype=np.int64)
        if not n or not self.names:
            return won
        points = np.array(sorted(self.classes), dtype=np.int64)
        rows = np.array([self.classes[p] for p in points.tolist()], dtype=np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(points, flat), len(points) - 1)
        flat = np.where(points[at] == flat, rows[at], 0).astype(np.int32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        begins = np.cumsum(lengths) - lengths
        by_length = np.argsort(-lengths, kind="stable")  # the longest first: those still running are a prefix
        lengths, begins = lengths[by_length], begins[by_length]
        state = np.tile(self.first, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        done, live = 0, int((lengths > 0).sum())
        while live > FEW:
            columns = np.arange(done, min(done + COLUMNS, int(lengths[0])))
            codes = flat[np.minimum(begins[:live, None] + columns, len(flat) - 1)]
            for k, column in enumerate(columns.tolist()):
                live = int(np.searchsorted(-lengths, -column, side="left"))
                d = state[:live]
                moved = d << one
                moved[:, 1:] |= d[:, :-1] >> top
                state[:live] = (moved & self.into[codes[:live, k]]) | (d & self.loops)
            done = int(columns[-1]) + 1
            live = int((lengths > done).sum())
        whole = lambda mask: int.from_bytes(mask.tobytes(), "little")
        into, loops = [whole(m) for m in self.into] if live else [], whole(self.loops)
        full = (1 << 64 * state.shape[1]) - 1
        for row in range(live):
            d = whole(state[row])
            for c in flat[begins[row] + done : begins[row] + lengths[row]].tolist():
                d = ((d << 1) & full & into[c]) | (d & loops)
            state[row] = np.frombuffer(d.to_bytes(8 * state.shape[1], "little"), dtype=np.uint64)
        word, bit = self.finals // 64, (self.finals % 64).astype(np.uint64)
        for rule in self.order[::-1].tolist():
            hit = (state[:, word[rule]] >> bit[rule]) & one
            won[by_length[hit.astype(bool)]] = rule
        return won


def compile_rules(rules: list[Rule]) -> Automaton:
    """Masks for rules, all in one machine."""
    parsed = [r.symbols() for r in rules]
    points = sorted({s for p in parsed for s in p if isinstance(s, int)})
    classes = {c: i + 1 for i, c in enumerate(points)}
    states = sum(sum(s != "*" for s in p) + 1 for p in parsed)
    words = max(1, -(-states // 64))
    bits = {k: np.zeros(words, dtype=np.uint64) for k in ("first", "loops")}
    into = np.zeros((len(points) + 1, words), dtype=np.uint64)
    finals, at = [], 0
    put = lambda mask, b: mask.__setitem__(b // 64, mask[b // 64] | np.uint64(1 << (b % 64)))
    for p in parsed:
        put(bits["first"], at)
        for s in p:
            if s == "*":
                put(bits["loops"], at)
                continue
            at += 1
            for row in range(len(points) + 1) if s is None else (classes[s],):
                put(into[row], at)
        finals.append(at)
        at += 1
    strength = [(-sum(s is not None and s != "*" for s in p), i) for i, p in enumerate(parsed)]
    order = np.array([i for _, i in sorted(strength)], dtype=np.int64)
    return Automaton([r.name for r in rules], [r.verdict for r in rules], order, bits["first"], bits["loops"], np.array(finals, dtype=np.int64), into, classes)


@dataclass
class Machines:
    """Rules of any number, as machines of bounded size; each with the numbers of its rules, and the last label of host that it serves (None: any)."""

    machines: list[tuple[str | None, np.ndarray, Automaton]]
    rank: np.ndarray  # of each rule, the strongest first

    @classmethod
    def of(cls, rules: list[Rule]) -> Machines:
        # a rule that leaves its last label open may fit any host
        label = lambda r: None if set("*?") & set(r.host.rpartition(".")[2]) else r.host.rpartition(".")[2]
        bits = lambda r: sum(s != "*" for s in r.symbols()) + 1
        machines, held, size = [], [], 0
        by_label = sorted(range(len(rules)), key=lambda i: (label(rules[i]) is not None, label(rules[i]) or "", i))
        for at, i in enumerate(by_label):
            held.append(i)
            size += bits(rules[i])
            last = at + 1 == len(by_label) or label(rules[by_label[at + 1]]) != label(rules[i])
            if last or size >= 64 * MACHINE_WORDS:
                machines.append((label(rules[i]), np.array(held, dtype=np.int64), compile_rules([rules[k] for k in held])))
                held, size = [], 0
        strength = lambda i: (-sum(s is not None and s != "*" for s in rules[i].symbols()), i)
        rank = np.empty(len(rules), dtype=np.int64)
        rank[sorted(range(len(rules)), key=strength)] = np.arange(len(rules))
        return cls(machines, rank)

    def winners(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """For each URL the number of the winning rule, or -1."""
        end = chr(0x10FFFF)  # stands for END inside Python's strings; host and path are cleared of it first
        texts = ["." + h.replace(end, "\ufffd") + end + p.replace(end, "\ufffd") for h, p in zip(hosts, paths, strict=True)]
        labels = np.array([h.rpartition(".")[2] for h in hosts], dtype=object)
        best = np.full(len(texts), len(self.rank), dtype=np.int64)
        for label, numbers, machine in self.machines:
            inner = Automaton(**{**machine.__dict__, "classes": {**machine.classes, ord(end): machine.classes.get(END, 0)}})
            at = np.arange(len(texts)) if label is None else np.flatnonzero(labels == label)
            step = max(1, STATE_BYTES // (8 * len(machine.first)))
            for s in range(0, len(at), step):
                some = at[s : s + step]
                won = inner.step_all([texts[i] for i in some.tolist()])
                best[some] = np.minimum(best[some], np.where(won >= 0, self.rank[numbers[won]], len(self.rank)))
        of = np.append(np.argsort(self.rank), -1)
        return of[best]


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages plus url_filter: struct<host, path, rule, verdict>; see the module's docstring."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((Machines.of(rules), [r.name for r in rules], [r.verdict for r in rules]))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machines, names, verdicts = shared.value
        for host, path in batches:
            won = machines.winners(host.fillna("").tolist(), path.fillna("").tolist()).tolist()
            yield pd.DataFrame({"rule": [names[k] if k >= 0 else None for k in won], "verdict": [verdicts[k] if k >= 0 else default for k in won]})

    url = F.col(f"page.`{url_col}`")
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    parts = pages.select(F.struct("*").alias("page")).select("page", ascii_lower(host).alias("host"), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0).alias("path"))
    seen = parts.withColumn("j", judged("host", "path"))
    return seen.select(*[F.col(f"page.`{c}`").alias(c) for c in pages.columns if c != "url_filter"], F.struct("host", "path", F.col("j.rule").alias("rule"), F.col("j.verdict").alias("verdict")).alias("url_filter"))
