"""Gated recurrent language model scores for whole documents.

Tokens are lower-cased words and one end per document. Counts over all training
documents give the base score (add 0.5) and sort the words into ``CLASSES``
classes by their last two bytes; the end is a class of its own. A class holds
its ``HEADS`` most frequent words and a slot for all others. The model reads
the slot of the token before, updates a gated recurrent state (GRU), and

    p(word) = p(class | state) * p(slot | class, state) [* share(word | other words of its class)]

where both factors are softmaxes over the state and the share is the word's
count plus 0.5 among the class's other words, with one 0.5 for all words that
were never seen. The probabilities of all words of a class add up to its own.

The network is written in numpy. It learns by truncated backpropagation: the
state goes on from window to window of ``TRAIN_STEPS`` tokens, the gradient
stops at the window. First one block of texts (about ``BLOCK_BYTES``) starts the
model; then every task goes on from it over all its training documents and the
mean of their parameters, by tokens, is the model. Scoring runs whole documents
side by side in lanes, in windows of ``SCORE_STEPS`` tokens, and carries the
state across windows until the document's end.

Words travel as codes into block vocabularies (``blocks``): a block's distinct
words meet the corpus counts by a window over the word and go back to the block,
so no document is shuffled. The driver receives ``CLASSES`` * ``HEADS`` words,
two numbers a class and at most ``MERGERS`` sets of parameters.

Defined results: a null or empty text is its end alone; a null id counts as the
empty text in the fold, so it is learned from; repeated rows are learned and
scored each; a text of any length is scored whole; without training documents
every count is 0 and the model is its seeded start; an empty table gives no
rows; other columns are ignored. The learned parameters, not the counts, hang
on how the table is split into tasks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftmix.llm.blocks import BLOCK_BYTES, BLOCK_ROWS, WITHIN, Numbers, byte_table, squeeze, unsqueeze, words_of
from weftmix.llm.common import id_bucket, regroup, stored, table

FOLDS, HELD_OUT = 5, 1
CLASSES, HEADS = 32, 32
SLOTS = HEADS + 1
END_CLASS = CLASSES
END = CLASSES * SLOTS
HIDDEN, EMBED = 16, 16
TRAIN_STEPS, TRAIN_LANES = 32, 256
SCORE_STEPS, SCORE_LANES = 64, 256
RATE = 0.006
#: The block that starts the model is read until it has given so many tokens,
#: at most so often.
WARM_TOKENS, WARM_PASSES = 3_000_000, 20
MERGERS = 4
WHITE = b"\t\n\x0b\f\r "
FLOAT = np.float32
#: The bias of a slot that no word takes; its probability and its gradient are 0.
NEVER = -1e9


# -- counts ---------------------------------------------------------------

BLOCK = ("block long, doc_id array<long>, held array<boolean>, size array<int>, words array<string>, class array<int>, "
         "n array<long>, occ binary")


def word_classes(words: pa.StringArray) -> np.ndarray:
    """The class of each word, from its last two bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8).astype(np.uint32)
    last = data[np.maximum(ends[1:] - 1, 0)]
    before = np.where(ends[1:] - ends[:-1] > 1, data[np.maximum(ends[1:] - 2, 0)], 0)
    return (((before * 256 + last) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32) % CLASSES


def _list(values, kind) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays([0, len(values)], values)


def _blocks(batches):
    number, lower = Numbers(), byte_table(b"", WHITE)
    for batch in regroup(batches, BLOCK_ROWS, BLOCK_BYTES):
        # after translation only the ends of documents are breaks
        raw = b"".join(t.encode("utf-8", "surrogatepass").translate(lower) + b"\n" for t in batch.column("text").to_pylist())
        codes, words, doc = words_of(raw)
        held = batch.column("held").to_numpy(zero_copy_only=False)
        n = np.bincount(codes[~held[doc]], minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number.take(len(codes))], pa.int64()), _list(batch.column("doc_id"), pa.int64()), _list(held, pa.bool_()),
             _list(np.bincount(doc, minlength=len(held)).astype(np.int32), pa.int32()), _list(words, pa.string()),
             _list(word_classes(words), pa.int32()), _list(n, pa.int64()), pa.array([squeeze(codes)], pa.binary())],
            names=[c.split()[0] for c in BLOCK.split(", ")])


class Counts:
    """What the corpus says: the base's totals, each class's most frequent
    words, and the counts of its others."""

    def __init__(self, tokens: int, distinct: int, ends: int, heads: dict[int, list[tuple[str, int]]], others: dict[int, tuple[int, int]]):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.words = [w for c in range(CLASSES) for w, _ in heads.get(c, [])]
        self.slots = np.array([c * SLOTS + i for c in range(CLASSES) for i in range(len(heads.get(c, [])))], np.int32)
        #: which slots no word takes, and what each slot counts (add 0.5)
        self.unused = np.zeros((CLASSES, SLOTS), bool)
        self.mass = np.full((CLASSES, SLOTS), 0.5)
        for c in range(CLASSES):
            own, (total, kinds) = [n for _, n in heads.get(c, [])], others.get(c, (0, 0))
            self.unused[c, len(own):HEADS] = True
            self.mass[c, :len(own)] += own
            self.mass[c, HEADS] = total + 0.5 * (kinds + 1)
        self.other = np.log10(self.mass[:, HEADS])

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


READY = "block long, doc_id array<long>, held array<boolean>, size array<int>, class binary, slot binary, count binary, occ binary"


def _ready(counts: Counts):
    """A block with the corpus count and the slot of each of its words."""
    heads = pa.array(counts.words, pa.string())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        out = []
        for i in range(left.num_rows):
            words, klass = left["words"][i].values.cast(pa.string()), left["class"][i].values.to_numpy()
            count = np.zeros(len(words), np.int64)
            count[right["at"].to_numpy()] = right["c"].to_numpy()
            head = pc.index_in(words, heads).fill_null(-1).to_numpy()
            slot = klass * SLOTS + HEADS
            slot[head >= 0] = counts.slots[head[head >= 0]]
            out.append({c: left[c][i].as_py() for c in ("block", "doc_id", "held", "size", "occ")}
                       | {"class": squeeze(klass.astype(np.int32)), "slot": squeeze(slot.astype(np.int32)), "count": squeeze(count)})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                                                    ("size", pa.list_(pa.int32())), ("class", pa.binary()), ("slot", pa.binary()),
                                                    ("count", pa.binary()), ("occ", pa.binary())]))
    return run


def count_tokens(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """(the blocks of READY, the corpus counts) of (doc_id, text, held); only
    rows that aren't held are counted."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "held")
    blocks = stored(docs.mapInArrow(_blocks, BLOCK), "lm-blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "class", "n")).alias("at", "x")).select(
        "block", F.col("at").cast("bigint").alias("at"), F.col("x.words").alias("word"), F.col("x.class").alias("class"), F.col("x.n").alias("n"))
    w = W.partitionBy("word")
    place = F.shiftleft("block", WITHIN) + F.col("at")
    known = stored(each.withColumn("c", F.sum("n").over(w)).withColumn("first", F.min(place).over(w) == place).filter("c > 0"), "lm-words")
    words = known.filter("first").select("word", "class", "c")
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    order = F.row_number().over(W.partitionBy("class").orderBy(F.desc("c"), "word"))
    heads: dict[int, list[tuple[str, int]]] = {}
    for r in words.withColumn("rank", order).filter(F.col("rank") <= HEADS).orderBy("class", "rank").collect():
        heads.setdefault(r["class"], []).append((r["word"], r["c"]))
    sums = {r["class"]: (r["c"], r["kinds"]) for r in words.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds")).collect()}
    others = {k: (c - sum(n for _, n in heads[k]), kinds - len(heads[k])) for k, (c, kinds) in sums.items()}
    counts = Counts(sum(c for c, _ in sums.values()) + ends, sum(k for _, k in sums.values()) + (ends > 0), ends, heads, others)
    ready = (blocks.select("block", "doc_id", "held", "size", "words", "class", "occ").groupBy("block")
             .cogroup(known.select("block", "at", "c").groupBy("block")).applyInArrow(_ready(counts), READY))
    return stored(ready, "lm-ready"), counts


# -- the network ----------------------------------------------------------

class GatedLM:
    """GRU over slots with a class-factored output."""

    SHAPES = {"embed": (END + 1, EMBED), "w": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
              "class_w": (HIDDEN, CLASSES + 1), "class_b": (CLASSES + 1,), "slot_w": (CLASSES, HIDDEN, SLOTS), "slot_b": (CLASSES, SLOTS)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        """``flat`` holds all parameters; without it they start at random."""
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            g = np.random.default_rng(seed)
            flat = np.concatenate([(g.normal(0, 0.1 if k.endswith(("d", "_w")) else HIDDEN ** -0.5, n) if not k.endswith("b") else np.zeros(n))
                                   for k, n in zip(self.SHAPES, sizes, strict=True)])
        self.flat = flat.astype(FLOAT)
        at = np.cumsum([0, *sizes])
        self.p = {k: self.flat[a:b].reshape(s) for (k, s), a, b in zip(self.SHAPES.items(), at, at[1:], strict=False)}

    def states(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """(h, states, cache) over a window: ``before`` (T, B) are the slots read,
        ``fresh`` marks where a document starts, ``h`` is the state carried in."""
        p, t_max, two = self.p, len(before), 2 * HIDDEN
        # a sigmoid is (1 + tanh of half its argument) / 2
        half = np.ones(3 * HIDDEN, FLOAT)
        half[:two] = 0.5
        gates, u_w = (p["embed"] @ (p["w"] * half))[before] + p["b"] * half, p["u"] * half
        on = (~fresh).astype(FLOAT)[:, :, None]
        starts = fresh.any(axis=1)
        out = np.empty((*before.shape, HIDDEN), FLOAT)
        cache = [np.empty((*before.shape, n), FLOAT) for n in (HIDDEN, two, HIDDEN, HIDDEN)] if keep else None
        for t in range(t_max):
            held = h * on[t] if starts[t] else h
            u = held @ u_w
            zr = np.tanh(gates[t, :, :two] + u[:, :two])
            zr += 1
            zr *= FLOAT(0.5)
            n = zr[:, HIDDEN:] * u[:, two:]
            n += gates[t, :, two:]
            np.tanh(n, out=n)
            h = held - n
            h *= zr[:, :HIDDEN]
            h += n
            out[t] = h
            if keep:
                for kept, value in zip(cache, (held, zr, n, u[:, two:]), strict=True):
                    kept[t] = value
        return h, out, cache

    def log_probs(self, h: np.ndarray, slot: np.ndarray, grads: dict | None = None, scale: float = 1.0):
        """Natural-log probability of each slot given its state (rows of h);
        with ``grads`` also the gradient of their scaled negative sum by h."""
        p, klass = self.p, np.minimum(slot // SLOTS, END_CLASS)
        # in order of the classes, so that each class is a slice
        order = np.argsort(klass, kind="stable")
        h, klass, inner = h[order], klass[order], (slot - klass * SLOTS)[order]
        rows = np.arange(len(slot))
        e = h @ p["class_w"]
        e += p["class_b"]
        out = e[rows, klass].astype(np.float64)
        np.exp(e, out=e)
        total = e @ np.ones(CLASSES + 1, FLOAT)
        out -= np.log(total)
        dh = None
        if grads is not None:
            e *= (FLOAT(scale) / total)[:, None]
            e[rows, klass] -= FLOAT(scale)
            grads["class_w"] += h.T @ e
            grads["class_b"] += e.sum(axis=0)
            dh = e @ p["class_w"].T
        ones = np.ones(SLOTS, FLOAT)
        edge = np.searchsorted(klass, np.arange(CLASSES + 1)).tolist()
        for c, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
            if a == b:
                continue
            e = h[a:b] @ p["slot_w"][c]
            e += p["slot_b"][c]
            at = (rows[:b - a], inner[a:b])
            out[a:b] += e[at]
            np.exp(e, out=e)
            total = e @ ones
            out[a:b] -= np.log(total)
            if grads is not None:
                e *= (FLOAT(scale) / total)[:, None]
                e[at] -= FLOAT(scale)
                grads["slot_w"][c] += h[a:b].T @ e
                grads["slot_b"][c] += e.sum(axis=0)
                dh[a:b] += e @ p["slot_w"][c].T
        back = np.empty_like(order)
        back[order] = rows
        return out[back], None if dh is None else dh[back]

    def gradients(self, before, fresh, slot, live, h):
        """(loss a token, gradients, state) of one window; only ``live`` places count."""
        p = self.p
        last, states, (held, zr, inner, un) = self.states(before, fresh, h, keep=True)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        n = max(int(live.sum()), 1)
        got, dflat = self.log_probs(states[live], slot[live], grads, 1 / n)
        dstates = np.zeros_like(states)
        dstates[live] = dflat
        # slopes of the gates, for the whole window
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        by_n = (1 - z) * (1 - inner * inner)
        by_z = (held - inner) * z * (1 - z)
        by_r = un * r * (1 - r)
        on = (~fresh).astype(FLOAT)[:, :, None]
        dgates, dh, back = np.empty((*before.shape, 3 * HIDDEN), FLOAT), np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        du = np.empty_like(dgates)
        for t in range(len(before) - 1, -1, -1):
            dh = dh + dstates[t]
            d, own = dgates[t], du[t]
            np.multiply(dh, by_z[t], out=d[:, :HIDDEN])
            np.multiply(dh, by_n[t], out=d[:, 2 * HIDDEN:])
            np.multiply(d[:, 2 * HIDDEN:], by_r[t], out=d[:, HIDDEN:2 * HIDDEN])
            own[:] = d
            own[:, 2 * HIDDEN:] *= r[t]
            dh = dh * z[t]
            dh += own @ back
            dh *= on[t]
        flat = dgates.reshape(-1, 3 * HIDDEN)
        grads["u"] += held.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
        grads["b"] += flat.sum(axis=0)
        # a slot's embedding gathers what all places that read it say
        read = before.ravel()
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(read[order]) != 0)))
        seen, gathered = read[order][first], np.add.reduceat(flat[order], first, axis=0)
        grads["w"] += p["embed"][seen].T @ gathered
        grads["embed"][seen] += gathered @ p["w"].T
        return -got.sum() / n, grads, last

    def learn(self, blocks, rate: float = RATE) -> int:
        """Adam over the windows of (tokens, sizes) blocks; returns the tokens read."""
        m1, m2, step, read = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0
        for tokens, sizes in blocks:
            lanes = Lanes(sizes, TRAIN_LANES)
            h = np.zeros((lanes.count, HIDDEN), FLOAT)
            for before, fresh, slot, live, _ in lanes.windows(tokens, TRAIN_STEPS):
                h = h[:before.shape[1]]
                _, grads, h = self.gradients(before, fresh, slot, live, h)
                flat, step = np.concatenate([g.ravel() for g in grads.values()]), step + 1
                m1 += FLOAT(0.1) * (flat - m1)
                m2 += FLOAT(0.01) * (flat * flat - m2)
                pace = rate / (1 + step / 500) ** 0.5
                self.flat -= (pace / (1 - 0.9 ** step)) * m1 / (np.sqrt(m2 / FLOAT(1 - 0.99 ** step)) + FLOAT(1e-8))
                read += int(live.sum())
        return read

    def document_scores(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per document the log10 probability of its slots, of any length."""
        lanes, out = Lanes(sizes, SCORE_LANES), np.zeros(len(sizes))
        h = np.zeros((lanes.count, HIDDEN), FLOAT)
        for before, fresh, slot, live, doc in lanes.windows(tokens, SCORE_STEPS):
            h, states, _ = self.states(before, fresh, h[:before.shape[1]])
            got, _ = self.log_probs(states[live], slot[live])
            out += np.bincount(doc[live], got, minlength=len(out))
        return out / np.log(10)


def untrained(counts: Counts) -> np.ndarray:
    """Seeded parameters whose biases say what the counts say."""
    model = GatedLM()
    mass = np.where(counts.unused, 0, counts.mass)
    model.p["class_b"][:] = np.log(np.append(mass.sum(axis=1), counts.ends + 0.5))
    model.p["slot_b"][:] = np.where(counts.unused, NEVER, np.log(counts.mass))
    return model.flat


class Lanes:
    """Documents of given sizes laid end to end in lanes of about equal length."""

    def __init__(self, sizes: np.ndarray, lanes: int):
        self.count = max(min(lanes, len(sizes)), 1)
        heap, own = [(0, i) for i in range(self.count)], [[] for _ in range(self.count)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, i = heapq.heappop(heap)
            own[i].append(d)
            heapq.heappush(heap, (load + int(sizes[d]), i))
        own.sort(key=lambda docs: -int(sizes[docs].sum()))
        order = np.array([d for docs in own for d in docs], np.int64)
        start = np.cumsum(sizes) - sizes
        #: place of every token in lane order, its document, and where documents start
        self.size = sizes[order]
        first = np.cumsum(self.size) - self.size
        self.take = np.repeat(start[order] - first, self.size) + np.arange(int(self.size.sum()))
        self.doc = np.repeat(order, self.size)
        self.fresh = np.zeros(len(self.take), bool)
        self.fresh[first] = True
        self.load = np.array([int(sizes[docs].sum()) for docs in own])
        self.offset = np.cumsum(self.load) - self.load

    def windows(self, tokens: np.ndarray, steps: int):
        """(slots before, document starts, slots, which places are tokens,
        documents), each (steps, lanes); lanes that are through leave."""
        flat = tokens[self.take]
        before = np.where(self.fresh, END, np.concatenate(([END], flat[:-1])))
        for t in range(0, int(self.load.max(initial=0)), steps):
            n = int(np.searchsorted(-self.load, -t))
            at = t + np.arange(min(steps, int(self.load[0]) - t))[:, None]
            live = at < self.load[:n]
            i = np.where(live, at + self.offset[:n], 0)
            yield before[i], self.fresh[i], flat[i], live, self.doc[i]


# -- blocks of the corpus -------------------------------------------------

def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot and word code of every token, sizes with the end, document of
    every token); the end's code is -1."""
    occ, slot, size = unsqueeze(row["occ"], np.int32), unsqueeze(row["slot"], np.int32), np.array(row["size"], np.int64)
    doc = np.repeat(np.arange(len(size)), size + 1)
    end = np.zeros(len(doc), bool)
    end[np.cumsum(size + 1) - 1] = True
    codes, tokens = np.full(len(doc), -1, np.int64), np.full(len(doc), END, np.int64)
    codes[~end] = occ
    tokens[~end] = slot[occ]
    return tokens, codes, size + 1, doc


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    tokens, _, sizes, doc = _tokens(row)
    own = ~np.array(row["held"], bool)
    return tokens[own[doc]], sizes[own]


PARAMETERS = "tokens long, flat binary"


def _parameters(tokens: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.astype(FLOAT).tobytes()], pa.binary())], names=["tokens", "flat"])


def _learn(start: np.ndarray, rate: float, least: int = 0):
    """Each block is read once, or as often as gives ``least`` tokens, up to ``WARM_PASSES`` times."""
    def run(batches):
        model = GatedLM(start)

        def blocks():
            for batch in batches:
                for row in batch.to_pylist():
                    tokens, sizes = _training(row)
                    for _ in range(min(WARM_PASSES, max(1, -(-least // max(len(tokens), 1)))) if len(sizes) else 0):
                        yield tokens, sizes
        read = model.learn(blocks(), rate)
        if read:
            yield _parameters(read, model.flat)
    return run


def _merge(batches):
    """The mean of parameters, by the tokens that they have read."""
    total, flat = 0, None
    for batch in batches:
        for tokens, data in zip(batch.column("tokens").to_pylist(), batch.column("flat").to_pylist(), strict=True):
            own = np.frombuffer(data, FLOAT).astype(np.float64) * tokens
            total, flat = total + tokens, own if flat is None else flat + own
    if total:
        yield _parameters(total, flat / total)


def train(ready: DataFrame, counts: Counts) -> np.ndarray:
    """The learned parameters as one array."""
    fields = ready.select("block", "held", "size", "slot", "occ")
    any_training = fields.filter(F.exists("held", lambda h: ~h))
    first = any_training.agg(F.min("block")).first()[0]
    if first is None:
        return untrained(counts)
    warm = any_training.filter(F.col("block") == first).mapInArrow(_learn(untrained(counts), RATE, WARM_TOKENS), PARAMETERS).collect()
    start = np.frombuffer(warm[0]["flat"], FLOAT)
    parts = any_training.mapInArrow(_learn(start, RATE / 4), PARAMETERS)
    merged = parts.repartition(MERGERS).mapInArrow(_merge, PARAMETERS).collect()
    total = sum(r["tokens"] for r in merged)
    return sum(np.frombuffer(r["flat"], FLOAT).astype(np.float64) * r["tokens"] for r in sorted(merged, key=lambda r: zlib.crc32(r["flat"]))) / total


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(counts: Counts, flat: np.ndarray):
    def run(batches):
        model = GatedLM(flat)
        for batch in batches:
            for row in batch.to_pylist():
                tokens, codes, sizes, doc = _tokens(row)
                count = unsqueeze(row["count"], np.int64)
                # one more entry for the end, which every training document has
                base = np.append(counts.base(count), counts.base(np.array([counts.ends]))[0])
                known = np.append(count > 0, counts.ends > 0)
                klass = unsqueeze(row["class"], np.int32)
                other = unsqueeze(row["slot"], np.int32) % SLOTS == HEADS
                share = np.append(np.where(other, np.log10(count + 0.5) - counts.other[klass], 0.0), 0.0)

                def total(values, doc=doc, codes=codes, n=len(sizes)):
                    return np.bincount(doc, values[codes], minlength=n)
                score = model.document_scores(tokens, sizes) + total(share)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()),
                     pa.array(total(known.astype(np.float64)).astype(np.int64)), pa.array(np.full(n, counts.tokens)), pa.array(total(base)),
                     pa.array(score)], names=[c.split()[0] for c in SCORES.split(", ")])
    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """One row of SCORES for each row of ``docs`` (doc_id, text, held); what is
    learned comes from the rows that aren't held."""
    ready, counts = count_tokens(docs)
    return ready.mapInArrow(_score(counts, train(ready, counts)), SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held"))
    return score_documents(docs)
