"""LM scoring by context-tree weighting over bytes, beside a unigram base.

A text is its lower-case words, a space between two, and a closing newline; no
byte of it is lost to the word sequence.  Each byte is eight binary choices.  In
every context of 0 to ``DEPTH`` bytes each choice has a Krichevsky-Trofimov
estimate, and the tree of contexts is weighted from its leaves (Willems et al.,
1995): a node holds half its own estimate and half the product of its children.
The trained tree is then frozen: a choice's probability mixes the estimates on
its path by those weights, and the deepest context seen in training takes what
is left.  Probabilities of all continuations of a context sum to one.

How it is spread over a cluster:

* A task packs its texts into blocks of about ``BLOCK`` bytes and sends the
  block's distinct grams (context and byte) with their training counts to the
  partition that owns the context's last three bytes.
* A partition merges what it gets as it streams in and weights the tree below
  three bytes in numpy; the few nodes above are weighted in SQL.
* The blocks' grams stream past the finished model, and the answers, one number
  per distinct gram, meet the block again.  Word counts of the base go the
  same way.

Nothing is broadcast but the nodes of contexts of at most one byte, at most
65,280 rows, and no task holds more than one block or one partition's model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm import labelled
from quillgraph.llm.common import fold, mix64, normal_words, partitions_for, text_of

DEPTH = 5
SHALLOW = 3  # contexts of so many bytes are owned by one partition
HELD_MODULUS, HELD_REST = 7, 2
BLOCK = 8 << 20
BYTES_PER_PARTITION = 32 << 20
MERGE = 1 << 20

TEXT, GRAMS, WORDS = 0, 1, 2
ASKED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("payload", pa.binary()), ("more", pa.binary())])
ASKED_SQL = "kind int, block bigint, part int, ids array<bigint>, payload binary, more binary"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses sorted ones well."""
    return _squeeze(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def normal_text(text: str | None) -> bytes:
    return b" ".join(normal_words(text)) + b"\n"


def grams_of(texts: list[bytes]) -> np.ndarray:
    """The gram of every byte of every text: ``DEPTH`` bytes before it and itself; newlines stand before a text."""
    pad = b"\n" * DEPTH
    data = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    grams = np.zeros(len(data) - DEPTH, np.uint64)
    for at in range(DEPTH + 1):
        grams = (grams << np.uint64(8)) | data[at : len(data) - DEPTH + at]
    lengths = np.array([len(t) for t in texts])
    first = np.zeros(len(data) - DEPTH, bool)  # those that end in a later text's padding
    starts = np.cumsum(lengths + DEPTH)[:-1]
    for at in range(DEPTH):
        first[starts - DEPTH + at] = True
    return grams[~first]


def owner(grams: np.ndarray, parts: int) -> np.ndarray:
    return (mix64((grams >> np.uint64(8)) & np.uint64((1 << 8 * SHALLOW) - 1)) % np.uint64(parts)).astype(np.int32)


def _word_owner(words: list[bytes], parts: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int32, len(words))


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _split(owners: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner and the places of its entries, in order."""
    order = np.argsort(owners, kind="stable")
    parts, start = np.unique(owners[order], return_index=True)
    yield from zip(parts.tolist(), np.split(order, start[1:]))


def _block_grams(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block and their training counts, 0 for those of held-out texts only."""
    keys, counts = [], []
    for flag in (False, True):
        some = [t for t, h in zip(texts, held) if h == flag]
        if some:
            found, n = np.unique(grams_of(some), return_counts=True)
            keys.append(found)
            counts.append(n * (not flag))
    return _counted(np.concatenate(keys), np.concatenate(counts))


def _block_words(texts: list[bytes], held: np.ndarray) -> dict[bytes, int]:
    """Distinct words of a block in order of appearance and their training counts; the empty word is the end."""
    found: dict[bytes, int] = {}
    for text, out in zip(texts, held):
        for word in text[:-1].split(b" ") if len(text) > 1 else []:
            found[word] = found.get(word, 0) + (not out)
        found[b""] = found.get(b"", 0) + (not out)
    return found


def _ask(parts: int):
    """Turn documents into blocks and what each block asks of the owners."""

    def block_rows(number: int, ids: list, held: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [(TEXT, number, 0, ids, _squeeze(b"".join(texts)), np.array(held, np.uint8).tobytes())]
        grams, counts = _block_grams(texts, np.array(held))
        for part, at in _split(owner(grams, parts)):
            rows.append((GRAMS, number, part, None, _pack(grams[at]), _pack(counts[at])))
        words = _block_words(texts, np.array(held))
        spelled, n = list(words), np.fromiter(words.values(), np.int64, len(words))
        for part, at in _split(_word_owner(spelled, parts)):
            rows.append((WORDS, number, part, None, _squeeze(b"\n".join([spelled[i] for i in at.tolist()])), _pack(n[at])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ASKED.types)], schema=ASKED)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch, some in labelled.text_blocks(batches, 2):
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), some):
                ids.append(doc_id)
                held.append(out)
                texts.append(normal_text(text))
                size += len(texts[-1])
                if size >= BLOCK:
                    yield from block_rows(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
        if texts:
            yield from block_rows(number, ids, held, texts)

    return run


def log_kt(a, b, log=np.log):
    """Log probability of ``a`` zeros and ``b`` ones by the Krichevsky-Trofimov estimator, for arrays or columns."""

    def log_gamma(x):
        z, product = x + 8.0, x
        for i in range(1, 8):
            product = product * (x + float(i))
        series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
        return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + series - log(product)

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def _nodes(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of contexts of ``depth`` bytes, sorted, with their counts of zeros and ones.

    A node is the context, oldest byte first, and a last byte that is 1
    followed by the choices made so far.
    """
    keys, n = _counted(grams & np.uint64((1 << 8 * (depth + 1)) - 1), counts)
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    node = np.concatenate([context | np.uint64(1 << j) | byte >> np.uint64(8 - j) for j in range(8)])
    ones = np.concatenate([(byte >> np.uint64(7 - j)) & np.uint64(1) for j in range(8)]).astype(bool)
    found, at = np.unique(node, return_inverse=True)
    n = np.tile(n, 8).astype(np.float64)
    return found, np.bincount(at, n * ~ones, len(found)), np.bincount(at, n * ones, len(found))


class Deep:
    """The part of the tree that one partition owns: contexts of ``SHALLOW`` to ``DEPTH`` bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.levels = grams, []
        below = None
        for depth in range(DEPTH, SHALLOW - 1, -1):
            keys, a, b = _nodes(grams, counts, depth)
            own = log_kt(a, b)
            if below is None:
                weighted, stop = own, np.ones(len(keys))
            else:
                parent = np.searchsorted(keys, below["keys"] & np.uint64((1 << 8 * (depth + 1)) - 1))
                below["parent"] = parent
                weighted = np.logaddexp(own, np.bincount(parent, below["weighted"], len(keys))) - math.log(2)
                stop = np.exp(own - weighted - math.log(2))
            below = {"keys": keys, "a": a, "b": b, "weighted": weighted, "stop": stop}
            self.levels.insert(0, below)

    def log_probabilities(self, mixed: np.ndarray, rest: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """Natural logs for ``grams``, given what the contexts above say of the top level's nodes.

        ``mixed`` is the weighted probability of a one gathered so far, ``rest``
        the weight left, ``ended`` the probability if no deeper context is known.
        """
        for level in self.levels:
            if "parent" in level:
                mixed, rest, ended = mixed[level["parent"]], rest[level["parent"]], ended[level["parent"]]
            one = (level["b"] + 0.5) / (level["a"] + level["b"] + 1.0)
            ended = np.where(level["a"] + level["b"] > 0, mixed + rest * one, ended)
            mixed, rest = mixed + rest * level["stop"] * one, rest * (1 - level["stop"])
        context, byte = self.grams >> np.uint64(8) << np.uint64(8), self.grams & np.uint64(255)
        total = np.zeros(len(self.grams))
        for j in range(8):
            one = ended[np.searchsorted(level["keys"], context | np.uint64(1 << j) | byte >> np.uint64(8 - j))]
            total += np.log(np.where(byte >> np.uint64(7 - j) & np.uint64(1), one, 1 - one))
        return total


def _merge_grams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for batch in batches:
        for payload, more in zip(batch.column("payload"), batch.column("more")):
            held.append((_unpack(payload.as_py()), _unpack(more.as_py()).astype(np.int64)))
            size += len(held[-1][0])
            if size > max(MERGE, 2 * len(held[0][0])):
                held, size = [_counted(*(np.concatenate(x) for x in zip(*held)))], 0
    return _counted(*(np.concatenate(x) for x in zip(*held)))


_MODEL = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("more", pa.binary()), ("key", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("weighted", pa.float64())])
_MODEL_SQL = "part int, payload binary, more binary, key bigint, a double, b double, weighted double"


def _train(parts: int):
    """One row with the merged grams of each part, and a row for each node of ``SHALLOW`` bytes."""

    def run(batches):
        grams, counts = _merge_grams(batches)
        # Two parts may share a partition: their contexts are apart all the same.
        for part, at in _split(owner(grams, parts)):
            own, n = grams[at], counts[at]
            top = Deep(own, n).levels[0]
            size = len(top["keys"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([part], [_pack(own)], [_pack(n)], [None], [None], [None], [None]), _MODEL.types)], schema=_MODEL)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, part, np.int32)), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), pa.array(top["keys"].astype(np.int64)),
                 pa.array(top["a"]), pa.array(top["b"]), pa.array(top["weighted"])], schema=_MODEL,
            )

    return run


def _above(nodes: DataFrame) -> DataFrame:
    """``part, key, mixed, rest, ended`` for the ``SHALLOW`` nodes, from the contexts above them."""
    log = F.log
    levels, below = [], nodes.filter("a + b > 0").select("key", "a", "b", "weighted")
    for depth in range(SHALLOW - 1, -1, -1):
        up = F.col("key").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))
        # Sums of whole numbers are exact; those of logs are taken as decimals, so reruns agree.
        sums = below.groupBy(up.alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("weighted").cast("decimal(38,9)")).cast("double").alias("children"))
        own = sums.withColumn("own", log_kt(F.col("a"), F.col("b"), log))
        most = F.greatest("own", "children")
        total = most + log(F.exp(F.col("own") - most) + F.exp(F.col("children") - most)) - F.lit(math.log(2))
        below = scale.cut(own.withColumn("weighted", total).withColumn("stop", F.exp(F.col("own") - F.col("weighted") - F.lit(math.log(2)))))
        levels.insert(0, below)
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    known = levels[0].select("key", (F.col("stop") * one).alias("mixed"), (1 - F.col("stop")).alias("rest"), one.alias("ended"))
    every = [known]
    for depth in range(1, SHALLOW):
        up = F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("up")
        parent = known.select(F.col("key").alias("up"), "mixed", "rest", "ended")
        joined = levels[depth].withColumn("up", up).join(parent, "up")
        known = joined.select(
            "key", (F.col("mixed") + F.col("rest") * F.col("stop") * one).alias("mixed"), (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
            (F.col("mixed") + F.col("rest") * one).alias("ended"),
        )
        every.append(known)
    out = nodes.select("part", "key")
    for depth in range(SHALLOW - 1, -1, -1):
        up = F.col("key").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))
        told = every[depth].select(F.col("key").alias(f"up{depth}"), F.struct("mixed", "rest", "ended").alias(f"told{depth}"))
        # At most 255 nodes for each of 256 contexts of one byte.
        out = out.withColumn(f"up{depth}", up).join(F.broadcast(told) if depth < 2 else told, f"up{depth}", "left")
    full = F.col(f"told{SHALLOW - 1}")
    ended = F.coalesce(*(F.col(f"told{d}.ended") for d in range(SHALLOW - 1, -1, -1)), F.lit(0.5))
    return out.select("part", "key", F.coalesce(full["mixed"], F.lit(0.0)).alias("mixed"), F.coalesce(full["rest"], F.lit(0.0)).alias("rest"), ended.alias("ended"))


_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_ANSWER_SQL = "kind int, block bigint, part int, payload binary"


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part: the part's grams (step 0), its nodes (step 1), then what blocks ask (step 2)."""
    part, grams, counts, nodes, model = None, None, None, [], None
    for batch in batches:
        out = []
        steps, parts = batch.column("step").to_numpy(), batch.column("part").to_numpy()
        edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(steps) != 0)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
            if not end:
                continue
            some, step = batch.slice(begin, end - begin), steps[begin]
            if step == 0:
                part, nodes, model = parts[begin], [], None
                grams, counts = _unpack(some.column("payload")[0].as_py()), _unpack(some.column("more")[0].as_py())
            elif step == 1:
                nodes.append([some.column(c).to_numpy() for c in ("key", "mixed", "rest", "ended")])
            else:
                if model is None:
                    deep = Deep(grams, counts.astype(np.int64))
                    key, *told = (np.concatenate(x) for x in zip(*nodes))
                    order = np.argsort(key)
                    assert (key[order].astype(np.uint64) == deep.levels[0]["keys"]).all(), "nodes and grams of a part differ"
                    model = deep.log_probabilities(*(x[order] for x in told))
                for block, payload in zip(some.column("block").to_pylist(), some.column("payload")):
                    found = model[np.searchsorted(grams, _unpack(payload.as_py()))]
                    out.append((GRAMS, block, int(part), _squeeze(found.astype("<f4").tobytes())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER.types)], schema=_ANSWER)


_COUNTED = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("more", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])


def _count_words(parts: int):
    def run(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            for payload, more in zip(batch.column("payload"), batch.column("more")):
                for word, n in zip(_expand(payload.as_py()).split(b"\n"), _unpack(more.as_py()).astype(np.int64).tolist()):
                    found[word] = found.get(word, 0) + n
        spelled, n = list(found), np.fromiter(found.values(), np.int64, len(found))
        for part, at in _split(_word_owner(spelled, parts)):
            rows = [(part, _squeeze(b"\n".join([spelled[i] for i in at.tolist()])), _pack(n[at]), int(n[at].sum()), int((n[at] > 0).sum()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTED.types)], schema=_COUNTED)

    return run


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        out = []
        for step, part, block, payload, more in zip(*(batch.column(c).to_pylist() for c in ("step", "part", "block", "payload", "more"))):
            spelled = _expand(payload).split(b"\n")
            if step == 0:
                known = dict(zip(spelled, _unpack(more).astype(np.int64).tolist()))
            else:
                counts = np.fromiter(map(known.__getitem__, spelled), np.int64, len(spelled))
                out.append((WORDS, block, part, _pack(counts)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER.types)], schema=_ANSWER)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_block(parts: int, tokens: int, distinct: int, row: tuple, answers: dict) -> pa.RecordBatch:
    ids, payload, more = row
    held = np.frombuffer(more, np.uint8).astype(bool)
    texts = [t + b"\n" for t in _expand(payload).split(b"\n")[:-1]]
    # The owners' answers in the order in which the block asked.
    keys, _ = _block_grams(texts, held)
    natural = np.zeros(len(keys))
    for part, at in _split(owner(keys, parts)):
        natural[at] = np.frombuffer(_expand(answers[GRAMS, part]), "<f4")
    grams, lengths = grams_of(texts), np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    score = np.add.reduceat(natural[np.searchsorted(keys, grams)], starts) / math.log(10)
    spelled = list(_block_words(texts, held))
    counts = np.zeros(len(spelled), np.int64)
    for part, at in _split(_word_owner(spelled, parts)):
        counts[at] = _unpack(answers[WORDS, part]).astype(np.int64)
    at = {word: i for i, word in enumerate(spelled)}
    words = [[*(t[:-1].split(b" ") if len(t) > 1 else []), b""] for t in texts]
    n_tokens = np.array([len(w) for w in words])
    each = counts[np.fromiter((at[w] for some in words for w in some), np.int64, n_tokens.sum())]
    begin = np.cumsum(n_tokens) - n_tokens
    base = np.add.reduceat(np.log10((each + 1) / (tokens + distinct + 1)), begin)
    known = np.add.reduceat((each > 0).astype(np.int64), begin)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(held), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)], schema=_SCORES
    )


def _score(parts: int, tokens: int, distinct: int):
    def run(batches):
        block, row, answers = None, None, {}
        for batch in batches:
            for kind, number, part, ids, payload, more in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "part", "ids", "payload", "more"))):
                if kind == TEXT:
                    if row is not None:
                        yield _score_block(parts, tokens, distinct, row, answers)
                    block, row, answers = number, (ids, payload, more), {}
                else:
                    assert number == block, "an answer came without its block"
                    answers[kind, part] = payload
        if row is not None:
            yield _score_block(parts, tokens, distinct, row, answers)

    return run


def _dealt(df: DataFrame, parts: int, by: str, *order: str | Column) -> DataFrame:
    return df.repartition(parts, by).sortWithinPartitions(by, *order)


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Scores are base-10 logs: ``score`` of the text under the weighted tree,
    ``base_score`` of its tokens under smoothed unigram counts.  What is held
    out (by default a seventh, by the id's CRC-32) is scored but not learnt
    from.  Null text counts as empty: one end token.  Repeated rows count and
    are scored each.  Without training text every byte costs eight bits.  No
    rows give no rows.
    """
    held = fold("doc_id", HELD_MODULUS) == HELD_REST if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(size, BYTES_PER_PARTITION)
    asked = scale.cut(rows.mapInArrow(_ask(parts), ASKED_SQL))

    grams = asked.filter(F.col("kind") == GRAMS).select("part", "block", "payload", "more")
    model = scale.cut(grams.select("part", "payload", "more").repartition(parts, "part").mapInArrow(_train(parts), _MODEL_SQL))
    merged = model.filter("key IS NULL").select("part", "payload", "more")
    above = _above(model.filter("key IS NOT NULL"))
    empty, none = F.lit(None).cast("binary"), F.lit(None).cast("double")
    steps = (
        merged.select(F.lit(0).alias("step"), "part", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("key"), none.alias("mixed"), none.alias("rest"), none.alias("ended"), "payload", "more")
        .unionByName(above.select(F.lit(1).alias("step"), "part", F.lit(0).cast("long").alias("block"), "key", "mixed", "rest", "ended", empty.alias("payload"), empty.alias("more")))
        .unionByName(grams.select(F.lit(2).alias("step"), "part", "block", F.lit(0).cast("long").alias("key"), none.alias("mixed"), none.alias("rest"), none.alias("ended"), "payload", empty.alias("more")))
    )
    likely = _dealt(steps, parts, "part", "step").mapInArrow(_answer_grams, _ANSWER_SQL)

    words = asked.filter(F.col("kind") == WORDS).select("part", "block", "payload", "more")
    counted = scale.cut(words.select("part", "payload", "more").repartition(parts, "part").mapInArrow(_count_words(parts), "part int, payload binary, more binary, tokens bigint, distinct bigint"))
    got = counted.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = got["tokens"] or 0, got["distinct"] or 0
    looked = counted.select(F.lit(0).alias("step"), "part", F.lit(0).cast("long").alias("block"), "payload", "more").unionByName(
        words.select(F.lit(1).alias("step"), "part", "block", "payload", "more")
    )
    frequent = _dealt(looked, parts, "part", "step").mapInArrow(_answer_words, _ANSWER_SQL)

    texts = asked.filter(F.col("kind") == TEXT)
    answers = likely.unionByName(frequent).select("kind", "block", "part", F.lit(None).cast("array<bigint>").alias("ids"), "payload", empty.alias("more"))
    met = _dealt(texts.unionByName(answers), parts, "block", "kind", "part")
    scored = met.mapInArrow(_score(parts, tokens, distinct), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
