"""Secret scans by rules and a character convolutional network (operator 7).

The rules find assignments, access keys and hexadecimal strings.  The network
judges every candidate: each run of ``[A-Za-z0-9+/_.=-]`` that has LEAST
characters and a digit, or LONG characters of any kind, and each value that a
rule found, together with CONTEXT characters on either side.  Characters are
embedded, convolved, pooled by maximum and weighed.

Labels are not the rules' alone.  Findings are candidates that a rule or one
of the published token FORMATS marks, each also shown with its context blank,
and DRAWN findings, random values of such formats and of plain random
characters set into contexts of the corpus; other candidates and DRAWN
harmless strings (addresses, dates, names of files and of variables) are not
findings.  A candidate that nothing marks, but that a first network, which
knows marked and drawn strings alone, takes for a finding, isn't learnt from.
All distinct windows of candidates are learnt from.  A hash deals those of
either kind into parts of about PART; a shard has one part of either kind, and
DRAWN strings of either kind set into its own contexts; where one kind has fewer
parts they are repeated, so that kinds keep their weight.  In each of EPOCHS
rounds every shard goes on from the common network, and their means are the
next one; a single shard is plain descent.  By a hash of the window half of all
labels train; a quarter fits the temperature of the scores; the last quarter
sets the threshold, the highest that keeps RECALL of its findings, by rank
among the scores of all shards, and tells the recall reached and the share of
the others that pass (``Network.recall`` and ``Network.passed``).
Spans of the rules always stay, the network adds spans of kind ``cnn``.

Texts are read once: what the rules find and what the network needs of each
candidate goes to a table, from which labels are chosen and scores are made.
Runs of bytes are looked for in all texts by numpy; a text is decoded and
matched only if it holds something that a rule or a candidate needs.

Cases: null and empty texts have no spans; an empty table gives an empty one;
without candidates the drawn strings alone are learnt from; candidates longer
than SHOWN characters are judged in windows, of which any SHOWN characters lie
in one, and have the score of the highest; very long texts are looked at in
parts that overlap; rows without doc_id are left out; repeated rows are each
scanned; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch, only
from leafmill.llm.words import text_of

PART, DRAWN, RECALL = 3000, 1500, 0.99
CONTEXT, SHOWN, LEAST, LONG = 24, 48, 12, 20
EMBED, FILTERS, REACH, EPOCHS = 8, 32, 5, 8
LENGTH = 2 * CONTEXT + SHOWN
#: Networks that one task adds up.
FAN_IN = 64
#: Windows that are gathered before they are scored.
AT_ONCE = 1 << 15
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Token formats that their issuers have published, and JSON web tokens.
FORMATS = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"
)
KINDS = ("assign", "access", "hex", "cnn")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_IN_RUN = np.zeros(256, bool)
_IN_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEXES = _DIGIT.copy()
_HEXES[97:103] = True
Span = tuple[str, int, int]
SEEN = "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, cand array<struct<start:bigint,end:bigint,found:boolean,windows:int>>, labels binary, codes binary"
FOUND = "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def base_spans(text: str) -> list[Span]:
    """The rules' findings by start, then kind as listed; offsets in code points."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, found): runs long enough, and values of rules that lie in none of them; found: a rule or format marks it."""
    runs = [m.span() for m in CANDIDATE.finditer(text) if len(m[0]) >= LONG or re.search("[0-9]", m[0])]
    out = [(a, b, overlaps(base, a, b) or FORMATS.search(text, a, b) is not None) for a, b in runs]
    for kind, a, b in base:
        if kind == "assign":  # the value alone; the keyword is its context
            a = ASSIGN.match(text, a).start(2)
        if not any(x < b and a < y for x, y in runs):
            out.append((a, b, True))
    return sorted(out)


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros(len(inside) + 2, bool)
    wide[1:-1] = inside
    edge = np.flatnonzero(wide[1:] != wide[:-1])
    start, end = edge[::2], edge[1::2]
    some = end - start >= least
    return start[some], end[some]


def suspects(column: pa.Array, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold what a rule needs, and which a candidate; all others have none of these."""
    data, offsets = text_of(column)
    n = len(offsets) - 1
    # A space between texts, so that nothing is found over their bounds.
    data, offsets = np.insert(data, offsets[1:-1], 32) if n > 1 else data, offsets + np.r_[np.arange(n), n - 1] if n else offsets
    rules, some = np.zeros(n, bool), np.zeros(n, bool)
    owner = lambda places: np.searchsorted(offsets, places, "right") - 1
    for lo in range(0, len(data), step):
        base = max(0, lo - 32)  # what crosses a cut is seen in the overlap, which is longer than any least length
        part = data[base : lo + step + 32]
        start, end = _runs(_IN_RUN[part], LEAST)
        if len(start):
            digits = np.logical_or.reduceat(np.r_[_DIGIT[part], False], np.stack([start, end], 1).ravel())[::2]
            cut = (start == 0) | (end == len(part))
            some[owner(start[digits | cut | (end - start >= LONG)] + base)] = True
        rules[owner(_runs(_HEXES[part], 24)[0] + base)] = True
    raw = data.tobytes()
    for m in re.finditer(rb"AKIA[A-Z0-9]{16}", raw):
        rules[owner(m.start())] = True
    raw = raw.lower()
    for word in _KEYWORDS:
        at = raw.find(word)
        while at >= 0:
            t = int(owner(at))
            rules[t] = True
            at = raw.find(word, int(offsets[t + 1]))
    return rules, some


def windows(start: int, end: int) -> list[int]:
    """Where in the text the windows of LENGTH begin in which a candidate is seen; any SHOWN characters lie in one."""
    first, last = start - CONTEXT, max(start, end - SHOWN) - CONTEXT
    return [*range(first, last, LENGTH - SHOWN), last]


def shown(text: str, start: int, end: int) -> np.ndarray:
    """uint8 (windows, LENGTH): the candidate between its contexts; bytes over 127 as 1, inside marked by the top bit."""
    around = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0") + text[start : end + CONTEXT]
    codes = np.frombuffer(around.encode("utf-32-le"), "<u4")
    out = np.zeros(2 * CONTEXT + max(SHOWN, end - start), np.uint8)
    out[: len(codes)] = np.where((codes > 127) | (codes == 0), 1, codes)
    out[CONTEXT : CONTEXT + end - start] |= 128
    return np.lib.stride_tricks.sliding_window_view(out, LENGTH)[np.array(windows(start, end)) - (start - CONTEXT)]


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


def labelled(marks: list[Span], start: int, end: int) -> list[int]:
    """For each window of a candidate whether it shows a finding (1), none (0), or too little of one to tell (-1)."""
    at = windows(start, end)
    if len(at) == 1:
        return [int(overlaps(marks, start, end))]
    out = []
    for lo in at:
        lo, hi = max(lo, start), min(lo + LENGTH, end)
        seen = [(min(b, hi) - max(a, lo), b - a) for _, a, b in marks if a < hi and lo < b]
        out.append(int(any(part >= min(16, size) for part, size in seen)) or -bool(seen))
    return out


def look(docs: DataFrame) -> DataFrame:
    """Of each row the rules' spans, the candidates, and the windows and labels of these; in one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base, cand, labels, codes = [[] for _ in range(n)], [[] for _ in range(n)], [b""] * n, [b""] * n
            rules, some = suspects(batch["text"])
            for i in np.flatnonzero(rules | some).tolist():
                text = batch["text"][i].as_py()
                base[i] = base_spans(text) if rules[i] else []
                parts, own = [], bytearray()
                for a, b, found in candidates(text, base[i]):
                    views = shown(text, a, b)
                    marks = base[i] + [("format", *m.span()) for m in FORMATS.finditer(text, a, b)] if found else []
                    own += np.array(labelled(marks, a, b), np.int8).tobytes()
                    parts.append(views.tobytes())
                    cand[i].append({"start": a, "end": b, "found": found, "windows": len(views)})
                labels[i], codes[i] = bytes(own), b"".join(parts)
            span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            each = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("found", pa.bool_()), ("windows", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in base], pa.list_(span)), pa.array(cand, pa.list_(each)), pa.array(labels, pa.binary()), pa.array(codes, pa.binary())],
                ["doc_id", "base", "cand", "labels", "codes"],
            )

    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(work, SEEN)


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    threshold: float = 1.0
    recall: float = 0.0
    passed: float = 0.0

    def _maps(self, codes: np.ndarray) -> np.ndarray:
        x = self.embed[codes]
        n = codes.shape[1] - REACH + 1
        x = np.concatenate([x[:, i : i + n] for i in range(REACH)], axis=2)
        return x

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self._maps(codes[i : i + 256]) @ self.conv + self.bias, 0).max(axis=1) @ self.out + self.out_bias for i in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(codes) / self.temperature, -500, 500)))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYLLABLES = "ab ac al an ar as at ca co de di en er es ha he id in is it la le li lo ma me mi mo na ne no on or ra re ri ro se si so st ta te ti to ul un ur us ve vi".split()


def drawn(n: int, contexts: np.ndarray, seed: int | list[int] = 3) -> tuple[np.ndarray, np.ndarray]:
    """(codes, y): n findings and n harmless strings, made at random, the same for one seed; contexts are windows of the corpus."""
    draw = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in draw.integers(0, len(alphabet), k))
    some = lambda options: options[int(draw.integers(len(options)))]
    word = lambda k=3: "".join(some(_SYLLABLES) for _ in range(int(draw.integers(1, k + 1))))
    num = lambda a, b: int(draw.integers(a, b))
    secret = (
        lambda: "ghp_" + pick(_ALNUM, 36), lambda: "glpat-" + pick(_ALNUM + "-_", 20), lambda: f"xoxb-{num(10**10, 10**12)}-{pick(_ALNUM, 24)}", lambda: "sk_live_" + pick(_ALNUM, num(16, 33)),
        lambda: "AIza" + pick(_ALNUM + "-_", 35), lambda: "eyJ" + ".".join(pick(_ALNUM + "-_", num(12, 40)) for _ in range(3)), lambda: f"SG.{pick(_ALNUM, 22)}.{pick(_ALNUM, 43)}",
        lambda: pick(_ALNUM, num(16, 45)), lambda: pick(_ALNUM + "+/", num(22, 65)) + "=" * num(0, 3), lambda: pick("0123456789abcdef", some((24, 32, 40, 64))), lambda: pick("0123456789ABCDEF", some((32, 40, 64))), lambda: "AKIA" + pick(_ALNUM[:26] + "0123456789", 16),
    )
    plain = (
        lambda: f"www.{word()}.{some(('com', 'org', 'net'))}/{word()}/{word()}-{num(1, 9999)}.html", lambda: f"{num(1980, 2040)}-{num(1, 13):02d}-{num(1, 29):02d}T{num(0, 24):02d}", lambda: f"{word()}_{word()}_{word()}{num(1, 99)}",
        lambda: f"{word()}.{word()}{num(1, 999)}", lambda: ".".join(str(num(1, 256)) for _ in range(4)), lambda: f"/usr/{word()}/{word()}/{word()}.{some(('py', 'so', 'txt', 'h'))}{num(1, 9)}", lambda: str(num(10**11, 10**17)),
        lambda: f"+{num(1, 99)}-{num(100, 999)}-{num(100, 999)}-{num(1000, 9999)}", lambda: "".join(word().capitalize() for _ in range(num(3, 6))), lambda: f"v{num(1, 20)}.{num(0, 30)}.{num(0, 99)}-{word()}.{num(1, 9)}", lambda: word(8) + word(8), lambda: f"{word()}{word()}{word()}.{num(10, 99)}", lambda: f"{word()}-{word()}-{word()}-{num(1, 99)}",
        lambda: f"{num(1, 99)}/{num(1, 99)}/{num(1900, 2100)}-{num(1, 99)}", lambda: f"{word()}={num(1, 999)}.{num(0, 99)}", lambda: "=" * num(12, 40), lambda: "-" * num(20, 60), lambda: word(4).upper() + "_" + word(4).upper() + str(num(1, 99)),
    )
    before = ("", "", "", "pwd: ", "pwd=", "key = '", "Authorization: Bearer ", '"private_key": "', "credentials=", "auth ", "access ")
    rows, y = [], []
    for kind, makers in ((1, secret), (0, plain)):
        for _ in range(n):
            value = some(makers)()
            left = " " * CONTEXT
            right = " " * CONTEXT
            if len(contexts):
                row = contexts[int(draw.integers(len(contexts)))]
                inside = np.flatnonzero(row & 128)
                if len(inside) and inside[-1] < LENGTH - 1 and inside[0]:
                    left = bytes(row[: inside[0]] & 127).decode("latin-1").rjust(CONTEXT)
                    right = bytes(row[inside[-1] + 1 :] & 127).decode("latin-1").ljust(CONTEXT)
            left = (left + (some(before) if kind else ""))[-CONTEXT:]
            views = shown(left + value + right, len(left), len(left) + len(value))
            rows.append(views[int(draw.integers(len(views)))])
            y.append(kind)
    return np.stack(rows), np.array(y)


def blank(codes: np.ndarray) -> np.ndarray:
    """The same candidates with nothing around them."""
    return np.where(codes & 128, codes, 32).astype(np.uint8)


def begun(seed: int) -> Network:
    draw = np.random.default_rng(seed)
    wide = REACH * EMBED
    return Network(draw.normal(0, 0.5, (256, EMBED)), draw.normal(0, 1 / np.sqrt(wide), (wide, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.3, FILTERS), 0.0)


class Descent:
    """A network on its way: its weights with their first and second moments, as one vector that can be averaged."""

    def __init__(self, net: Network):
        own = [net.embed, net.conv, net.bias, net.out, np.array([net.out_bias])]
        self.shapes = [a.shape for a in own]
        self.state, self.step = np.concatenate([np.concatenate([a.ravel() for a in own]), np.zeros(2 * sum(a.size for a in own))]), 0

    def arrays(self) -> list[list[np.ndarray]]:
        """Views of weights, first moments and second moments."""
        cuts = np.cumsum([np.prod(x) for x in self.shapes] * 3)[:-1]
        views = np.split(self.state, cuts.astype(int))
        return [[v.reshape(x) for v, x in zip(views[i * len(self.shapes) :], self.shapes, strict=False)] for i in range(3)]

    def network(self) -> Network:
        *own, b = self.arrays()[0]
        return Network(*(a.copy() for a in own), float(b[0]))

    def epoch(self, codes: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> None:
        """Once over all labels, in small parts in random order."""
        p, m, v = self.arrays()
        embed, conv, bias, out, b = p
        net = Network(embed, conv, bias, out, 0.0)
        for part in np.array_split(draw.permutation(len(y)), max(1, len(y) // 64)):
            if not len(part):
                continue
            c = codes[part]
            x = net._maps(c)
            h = x @ conv + bias
            top = h.argmax(axis=1)
            best = np.take_along_axis(h, top[:, None, :], 1)[:, 0]
            act = np.maximum(best, 0)
            d = (1 / (1 + np.exp(-np.clip(act @ out + b[0], -50, 50))) - y[part]) / len(part)
            dh = np.outer(d, out) * (best > 0)
            seen = x[np.arange(len(part))[:, None], top]  # rows, filters, inputs
            d_conv = np.einsum("rf,rfi->if", dh, seen)
            d_in = dh[:, :, None] * conv.T[None]
            d_embed = np.zeros_like(embed)
            for k in range(REACH):
                ids = c[np.arange(len(part))[:, None], top + k]
                np.add.at(d_embed, ids, d_in[:, :, k * EMBED : (k + 1) * EMBED])
            self.step += 1
            for i, (a, g) in enumerate(zip(p, (d_embed, d_conv, dh.sum(axis=0), act.T @ d, d.sum(keepdims=True)), strict=True)):
                m[i][...], v[i][...] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                a -= 0.01 * (m[i] / (1 - 0.9**self.step)) / (np.sqrt(v[i] / (1 - 0.999**self.step)) + 1e-8)


_GRID = np.exp(np.linspace(np.log(0.05), np.log(50), 140))


def losses(net: Network, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed loss at each temperature of the grid."""
    signed = np.where(y == 1, -1, 1) * net.logits(codes)
    return np.array([np.logaddexp(0, signed / t).sum() for t in _GRID])


def train(codes: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """What ``learnt`` makes of shards, of labels that are in memory."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    fourth = len(y) // 4
    tested, tuned, own = order[:fourth], order[fourth : 2 * fourth], order[2 * fourth :]
    way = Descent(begun(seed))
    for _ in range(EPOCHS):
        way.epoch(codes[own], y[own], draw)
    net = way.network()
    if len(tuned):
        net.temperature = float(_GRID[int(np.argmin(losses(net, codes[tuned], y[tuned])))])
    scores = net.score(codes[tested])
    found = np.sort(scores[y[tested] == 1])
    # The highest threshold that still keeps the recall asked for.
    net.threshold = float(found[int((1 - RECALL) * len(found))]) if len(found) else 1.0
    net.recall = float((found >= net.threshold).mean()) if len(found) else 0.0
    net.passed = float((scores[y[tested] == 0] >= net.threshold).mean()) if (y[tested] == 0).any() else 0.0
    return net


def kept_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, codes): every window that tells whether it shows a finding, each once a task's batch."""
    for batch in batches:
        y = np.frombuffer(b"".join(batch["labels"].to_pylist()), np.int8)
        codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, LENGTH)
        for k in (0, 1):
            own = sorted({c.tobytes() for c in codes[y == k]})
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own, pa.binary())], ["y", "codes"])


def dealt(seen: DataFrame, scratch: Scratch, part: int = PART) -> tuple[DataFrame, int]:
    """(shard, found, other) with a row a shard, of all distinct windows; and the number of shards."""
    each = scratch.save(seen.where(F.length("labels") > 0).select("labels", "codes").mapInArrow(kept_windows, "y int, codes binary").distinct(), "labels")
    size = {r.y: r["count"] for r in each.groupBy("y").count().collect()}
    parts = [max(1, -(-size.get(k, 0) // part)) for k in (0, 1)]
    n = max(parts)
    own = F.pmod(F.xxhash64("codes"), F.when(F.col("y") == 1, parts[1]).otherwise(parts[0]))
    by_part = each.withColumn("part", own).groupBy("y", "part").agg(F.array_sort(F.collect_list("codes")).alias("codes"))
    # A kind with fewer parts has each in several shards.
    again = F.sequence(F.col("part"), F.lit(n - 1).cast("bigint"), F.when(F.col("y") == 1, parts[1]).otherwise(parts[0]).cast("bigint"))
    rows = by_part.withColumn("shard", F.explode(again)).groupBy("shard")
    joined = lambda k: F.coalesce(F.array_join(F.transform(F.flatten(F.collect_list(F.when(F.col("y") == k, F.col("codes")))), F.hex), ""), F.lit(""))
    shards = rows.agg(F.unhex(joined(1)).alias("found"), F.unhex(joined(0)).alias("other"))
    every = seen.sparkSession.range(n).select(F.col("id").alias("shard"))
    # Few shards have a file, and so a task, each.
    return every.join(shards, "shard", "left").repartition(min(n, 256 + n // 16)), n


def roles(codes: np.ndarray) -> np.ndarray:
    """By a hash of the candidate's window: 0 sets the threshold, 1 the temperature, 2 and 3 train."""
    return np.array([hashlib.blake2b(c.tobytes(), digest_size=1).digest()[0] & 3 for c in codes], np.int64)


def _labels(n_drawn: int):
    """Shards with all their labels: windows, blank ones and drawn strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, *raw in zip(*(batch[c].to_pylist() for c in ("shard", "found", "other")), strict=True):
                found, other = (np.frombuffer(x or b"", np.uint8).reshape(-1, LENGTH) for x in raw)
                made, y = drawn(n_drawn, other, [3, shard])
                codes = np.concatenate([other, found, blank(found), made])
                y = np.r_[np.zeros(len(other), np.int8), np.ones(2 * len(found), np.int8), y.astype(np.int8)]
                role = np.r_[roles(other), np.tile(roles(found), 2), roles(made)].astype(np.int8)
                # The first ``given`` labels are windows that nothing marks.
                columns = [pa.array([shard]), pa.array([len(other)]), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, y, role)]]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "given", "codes", "y", "role"])

    return work


def _each(shards: DataFrame, what, columns: str, first: Network | None) -> DataFrame:
    """``what`` (shard, codes, y, role) of each shard, as tuples; of unmarked windows only those that ``first`` takes for no finding, none without it."""
    names = [c.split()[0] for c in columns.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, given = batch["shard"][i].as_py(), batch["given"][i].as_py()
                codes, y, role = (np.frombuffer(batch[c][i].as_py(), kind) for c, kind in (("codes", np.uint8), ("y", np.int8), ("role", np.int8)))
                codes, keep = codes.reshape(-1, LENGTH), np.ones(len(y), bool)
                keep[:given] = first is not None and first.score(codes[:given]) < first.threshold
                rows = what(shard, codes[keep], y[keep].astype(np.int64), role[keep])
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows]) for k, n in enumerate(names)})

    return shards.mapInArrow(work, columns)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(weight, vector): the sums of a task's rows, as one row."""
    weight, total = 0, 0.0
    for batch in batches:
        for w, v in zip(batch["weight"].to_pylist(), batch["vector"].to_pylist(), strict=True):
            weight, total = weight + w, total + np.frombuffer(v)
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "vector"])


def _sum(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The sums of n rows of (weight, vector), made by tasks of FAN_IN rows in as many rounds as it takes."""
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        rows = rows.repartition(n).mapInArrow(_total, "weight bigint, vector binary")
    got = rows.collect()
    return sum(r.weight for r in got), sum((np.frombuffer(r.vector) for r in got), np.zeros(1))


def ranked(scores: DataFrame, rank: int) -> float:
    """The score (not negative) that has ``rank`` others before it in sorted order: its bits, 16 at a time, by counting."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        inside = scores.where(F.shiftright("bits", shift + 16) == prefix) if shift < 48 else scores
        for r in sorted(inside.groupBy(F.shiftright("bits", shift).alias("p")).count().collect()):
            if rank < r["count"]:
                prefix = r.p
                break
            rank -= r["count"]
    return float(np.array([prefix], np.int64).view(np.float64)[0])


def learnt(shards: DataFrame, n: int, scratch: Scratch, first: Network | None = None, seed: int = 11) -> Network:
    """A network from all labels of all shards."""
    way = Descent(begun(seed))
    for turn in range(EPOCHS):

        def further(shard, codes, y, role, state=way.state, step=way.step, turn=turn):
            own = Descent(begun(seed))
            own.state[:], own.step = state, step
            before = own.step
            own.epoch(codes[role > 1], y[role > 1], np.random.default_rng([seed, shard, turn]))
            # Shards weigh alike; the last number tells their steps.
            return [(1, np.r_[own.state, own.step - before].tobytes())]

        weight, total = _sum(_each(shards, further, "weight bigint, vector binary", first), n)
        way.state, way.step = total[:-1] / weight, way.step + round(total[-1] / weight)
    net = way.network()
    lost = lambda shard, codes, y, role: [(1, losses(net, codes[role == 1], y[role == 1]).tobytes())]
    net.temperature = float(_GRID[int(np.argmin(_sum(_each(shards, lost, "weight bigint, vector binary", first), n)[1]))])
    judged = lambda shard, codes, y, role: list(zip(y[role == 0].tolist(), net.score(codes[role == 0]).view(np.int64).tolist(), strict=True)) or [(-1, 0)]
    scores = scratch.save(_each(shards, judged, "y bigint, bits bigint", first).where("y >= 0"), "scores")
    found, other = (scores.where(F.col("y") == k) for k in (1, 0))
    n_found, n_other = found.count(), other.count()
    # The highest threshold that still keeps the recall asked for.
    net.threshold = ranked(found, int((1 - RECALL) * n_found)) if n_found else 1.0
    least = int(np.array([net.threshold]).view(np.int64)[0])
    net.recall, net.passed = (x.where(F.col("bits") >= least).count() / max(1, k) for x, k in ((found, n_found), (other, n_other)))
    return net


def fit(seen: DataFrame, scratch: Scratch, part: int = PART, n_drawn: int = DRAWN) -> Network:
    """A network from all windows of the candidates of all documents and from drawn strings."""
    rows, n = dealt(seen, scratch, part)
    shards = scratch.save(rows.mapInArrow(_labels(n_drawn), "shard bigint, given bigint, codes binary, y binary, role binary"), "shards")
    # What looks like a finding by the marked and drawn ones alone isn't learnt from as harmless.
    return learnt(shards, n, scratch, learnt(shards, n, scratch))


def scan(seen: DataFrame, net: Network) -> DataFrame:
    """(doc_id, found) of each row; found: all spans as structs of kind, start, end and the network's score."""
    model = seen.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            bases, cands = batch["base"].to_pylist(), batch["cand"].to_pylist()
            asked: list[np.ndarray] = []
            owner: list[tuple[int, list[dict]]] = []

            def judge() -> None:
                if asked:
                    size = [c["windows"] for _, own in owner for c in own]
                    scores = iter(np.maximum.reduceat(model.value.score(np.concatenate(asked)), np.cumsum([0, *size[:-1]])).tolist())
                    for i, own in owner:
                        judged = [(c["start"], c["end"], next(scores)) for c in own]
                        for s in bases[i]:
                            rows[i].append({**s, "score": max((p for a, b, p in judged if a < s["end"] and s["start"] < b), default=None)})
                        for a, b, p in judged:
                            if p >= model.value.threshold and not any(s["start"] < b and a < s["end"] for s in bases[i]):
                                rows[i].append({"kind": "cnn", "start": a, "end": b, "score": p})
                asked.clear()
                owner.clear()

            held = 0
            for i, own in enumerate(cands):
                if own:  # every rule's span has a candidate
                    asked.append(np.frombuffer(batch["codes"][i].as_py(), np.uint8).reshape(-1, LENGTH))
                    owner.append((i, own))
                    held += len(asked[-1])
                    if held > AT_ONCE:
                        judge()
                        held = 0
            judge()
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            order = lambda s: (s["start"], KINDS.index(s["kind"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([sorted(r, key=order) for r in rows], kind)], ["doc_id", "found"])

    return seen.select("doc_id", "base", "cand", "codes").mapInArrow(work, FOUND)


def secret_spans(docs: DataFrame, scratch: Scratch | None = None, part: int = PART) -> DataFrame:
    """(doc_id, found) of each row of docs; found: structs of kind, start, end (code points) and score."""
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    seen = scratch.save(look(docs), "seen")
    return scan(seen, fit(seen, scratch, part))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spelled = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "cnn")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
