"""Hidden Markov language model over word classes, with exact word counts inside a class.

P(text) = sum over state paths of prod P(state | state before) P(class | state), times
prod P(word | class). Words fall into a fixed number of classes by hash, so the part that
is trained, by Baum-Welch over all training texts, has a fixed size. P(word | class) comes
from the counts of all training words, a table that grows with the corpus and is joined,
never broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blogindex.llm.common import as_bytes, coded_words, drop_stored, fold, rows_of, stored, text_rows
from blogindex.session import exists, new_work_dir

STATES, CLASSES, ROUNDS = 8, 1 << 14, 5
# Tokens of the corpus shares that each state is given beside its own counts.
SMOOTHING = 1000.0
# Stands for the end of a text: no word holds a blank. It has a class of its own.
END = b" "
# Training texts are cut into windows of so many tokens for the expectation step.
WINDOW = 512
# Bytes of text, and words, that share a dictionary: the more text, the fewer words are counted
# and told their counts anew for each chunk. Numbers of more than 65,536 words take four bytes each.
CHUNK_BYTES, CHUNK_WORDS = 16_000_000, 300_000
# Chunks with together so many tokens are scored at once: their texts step through the recursion together.
TOGETHER = 1 << 20
# Expected counts are summed as whole numbers of this fraction, so that any order of adding gives the same model.
_UNIT = 1 << 16
_CHUNK = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
                    ("classes", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary())])
_CHUNK_DDL = ("kind string, chunk bigint, words array<binary>, times array<bigint>, classes binary, ids array<bigint>, "
              "held array<boolean>, lengths array<int>, tokens binary")


def word_class(word: bytes) -> int:
    return CLASSES if word == END else zlib.crc32(word) % CLASSES


def _class_column(word: Column) -> Column:
    return F.when(word == F.lit(END), CLASSES).otherwise(F.crc32(word) % CLASSES).cast("int")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, words) of the chunks, each written to a folder of its own in one pass."""
    path = new_work_dir(df.sparkSession, "chunks")
    df.write.partitionBy("kind").parquet(path)
    schema = StructType([f for f in df.schema if f.name != "kind"])
    return tuple(df.sparkSession.read.schema(schema).parquet(f"{path}/kind={kind}") if exists(df.sparkSession, f"{path}/kind={kind}")
                 else df.sparkSession.createDataFrame([], schema) for kind in ("texts", "words"))


def _number_type(n_words: int) -> type:
    return np.uint16 if n_words <= 1 << 16 else np.uint32


def chunked(docs: DataFrame, folds: int, held_fold: int) -> DataFrame:
    """Texts as runs of numbers into a dictionary, many texts to a chunk, in two rows.

    The row of kind 'texts' has the numbers, and the class of each word; that of kind 'words'
    the words and how often the training texts of the chunk hold them.
    """
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {END: 0}
        ids, held, lengths, tokens, size = [], [], [], [], 0

        def close():
            at, counts = np.concatenate(tokens), np.concatenate(lengths)
            train = np.repeat(~np.array(held, bool), counts)
            name = (part << 32) + number
            classes = np.array([word_class(w) for w in known], np.uint16).tobytes()
            return rows_of({
                "kind": ["texts", "words"], "chunk": [name, name], "words": [None, list(known)], "classes": [classes, None],
                "times": [None, np.bincount(at[train], minlength=len(known))], "ids": [ids, None], "held": [held, None],
                "lengths": [counts, None], "tokens": [at.astype(_number_type(len(known))).tobytes(), None]}, _CHUNK)

        for names, texts, out in text_rows(batches, 100):
            distinct, at, ends = coded_words(texts)
            numbers = np.array([known.setdefault(w, len(known)) for w in distinct], np.uint32)
            # Every text ends with the end token, of number 0.
            tokens.append(np.insert(numbers[at], ends, 0))
            lengths.append(np.diff(ends, prepend=0).astype(np.int32) + 1)
            ids += names
            held += out
            size += sum(len(t) for t in texts if t)
            if size >= CHUNK_BYTES or len(known) >= CHUNK_WORDS:
                yield close()
                number += 1
                known = {END: 0}
                ids, held, lengths, tokens, size = [], [], [], [], 0
        if ids:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("bigint"), as_bytes(), (fold(F.col("doc_id"), folds) == held_fold).alias("held"))
    return keyed.mapInArrow(run, _CHUNK_DDL)


@dataclass
class Model:
    """start (states), move (states x states), emit (classes x states), all probabilities."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """States that tend to stay, and the corpus shares of the classes bent at random in each."""
    rng = np.random.default_rng(seed)
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    emit = shares[:, None] * np.exp(rng.normal(0, 1.0, (len(shares), states)))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def log_likelihood(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion; all sequences step together."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    out = np.zeros(len(lengths))
    alpha = np.tile(model.start, (len(lengths), 1))
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        state = alpha[:n] if t == 0 else alpha[:n] @ model.move
        state = state * model.emit[classes[starts[:n] + t]]
        scale = state.sum(axis=1)
        alpha[:n] = state / scale[:, None]
        out[:n] += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, emit) counts of the sequences, summed over all state paths."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    order = np.argsort(-lengths, kind="stable")
    starts, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    for low in range(0, len(size), 512):
        first, n = starts[low:low + 512], size[low:low + 512]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right").tolist()
        alpha = np.zeros((steps, len(n), states))
        seen: list[np.ndarray] = []
        scales: list[np.ndarray] = []
        observed: list[np.ndarray] = []
        for t, k in enumerate(active):
            at = classes[first[:k] + t]
            b = model.emit[at]
            state = (model.start * b) if t == 0 else (alpha[t - 1, :k] @ model.move) * b
            scale = state.sum(axis=1)
            alpha[t, :k] = state / scale[:, None]
            seen.append(b)
            scales.append(scale)
            observed.append(at)
        beta = np.ones((len(n), states))
        shares: list[np.ndarray] = [np.zeros(0)] * steps
        for t in range(steps - 1, -1, -1):
            k = active[t]
            shares[t] = alpha[t, :k] * beta[:k]
            if t:
                after = seen[t] * beta[:k] / scales[t][:, None]
                move += alpha[t - 1, :k].T @ after
                beta[:k] = after @ model.move.T
        start += shares[0].sum(axis=0)
        at, share = np.concatenate(observed), np.concatenate(shares)
        for s in range(states):
            emit[:, s] += np.bincount(at, share[:, s], len(emit))
    return start, move * model.move, emit


def _windows(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the windows that consecutive sequences are cut into."""
    full, rest = lengths // WINDOW, lengths % WINDOW
    pieces = np.full(int((full + (rest > 0)).sum()), WINDOW, np.int64)
    ends = np.cumsum(full + (rest > 0)) - 1
    pieces[ends[rest > 0]] = rest[rest > 0]
    return pieces


def train_model(chunks: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts: each round sums expected counts over the tasks.

    The counts have the size of the model whatever the corpus is. In a round each window
    of a text starts anew; scoring does not cut texts. Emissions are drawn a little
    towards the corpus shares, so every class keeps some probability in every state.
    """
    model = first_model(shares, states)
    data = chunks.select("classes", "held", "lengths", "tokens")
    for _ in range(rounds):
        shared = chunks.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape)]
            for classes, held, lengths, raw in text_rows(batches, 1):
                sizes, out = np.array(lengths[0], np.int64), np.array(held[0], bool)
                own = np.frombuffer(classes[0], np.uint16).astype(np.int64)
                tokens = np.frombuffer(raw[0], _number_type(len(own)))[np.repeat(~out, sizes)]
                for part, more in zip(total, expected_counts(m, own[tokens], _windows(sizes[~out]))):
                    part += more
            flat = np.rint(np.concatenate([t.ravel() for t in total]) * _UNIT).astype(np.int64)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(flat[at], pa.int64())})

        summed = data.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(states + states * states + len(shares) * states)
        flat[summed["cell"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy() / _UNIT
        start, move, emit = np.split(flat, [states, states + states * states])
        move, emit = move.reshape(states, states) + 0.01, emit.reshape(-1, states) + SMOOTHING * shares[:, None]
        start = start + 0.01
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.unpersist()
    return model


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _together(rows: Iterator[tuple], lengths: int) -> Iterator[list[tuple]]:
    """The rows in runs of about TOGETHER tokens; a longer row is a run of its own."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += sum(row[lengths])
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for columns in text_rows(batches, 1):
        yield tuple(c[0] for c in columns)


def language_scores(docs: DataFrame, folds: int = 5, held_fold: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Learns from texts whose fold is not held_fold. A null or empty text is the end token
    alone. Rows are scored one by one, repeated and null ids too (a null id has the fold
    of empty text); other columns are ignored; an empty table gives no rows. Without
    training texts all words are unknown. Each text is read once and becomes numbers into
    the dictionary of its chunk; only the distinct words of each chunk meet the counts.
    """
    chunks, vocabulary = _split(chunked(docs, folds, held_fold))
    # Each word of a chunk moves once to the other chunks' counts of it, and its sum back.
    words_ = vocabulary.select("chunk", F.posexplode(F.arrays_zip("words", "times")).alias("at", "_w")) \
        .select("chunk", "at", F.col("_w.words").alias("word"), F.col("_w.times").alias("n"))
    same = Window.partitionBy("word")
    # A word is in a chunk once; its first chunk tells its class that it is there, if the training texts hold it.
    summed = words_.withColumns({"c": F.sum("n").over(same), "_first": F.min("chunk").over(same)}).select(
        "chunk", "at", "c", F.when((F.col("_first") == F.col("chunk")) & (F.col("c") > 0), _class_column(F.col("word"))).alias("kind"))
    placed = stored(summed, "placed")
    drop_stored(vocabulary)
    classes = placed.filter("kind IS NOT NULL").groupBy("kind").agg(
        F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()  # at most one row per class
    total, kinds = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    total[classes["kind"].to_numpy(dtype=np.int64)] = classes["c"].to_numpy()
    kinds[classes["kind"].to_numpy(dtype=np.int64)] = classes["v"].to_numpy()
    n, v = int(total.sum()), int(kinds.sum())
    model = train_model(chunks, (total + 0.5) / (n + 0.5 * len(total)), states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, total + 0.5 * (kinds + 1)))

    found = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("_c"))
    joined = chunks.join(found.select("chunk", F.transform("_c", lambda x: x["c"]).alias("c")), "chunk")

    def run(batches):
        m, mass = shared.value
        for chunk in _together(_each(batches), 2):
            sequences = []
            for _, _, lengths, raw, _, k in chunk:
                own = np.frombuffer(k, np.uint16).astype(np.int64)
                sequences.append(own[np.frombuffer(raw, _number_type(len(own)))])
            likely, at = log_likelihood(m, np.concatenate(sequences), np.concatenate([np.array(r[2], np.int64) for r in chunk])), 0
            for ids, held, lengths, raw, c, k in chunk:
                sizes, c, own = np.array(lengths, np.int64), np.array(c, np.float64), np.frombuffer(k, np.uint16)
                tokens = np.frombuffer(raw, _number_type(len(own)))
                starts = np.cumsum(sizes) - sizes
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                inside = np.log10((c + 0.5) / mass[own])
                yield rows_of({
                    "doc_id": ids, "held_out": held, "n_tokens": sizes,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64)[tokens], starts), "train_tokens": np.full(len(sizes), n),
                    "base_score": np.add.reduceat(base[tokens], starts),
                    "score": np.add.reduceat(inside[tokens], starts) + likely[at:at + len(sizes)]}, _SCORE)
                at += len(sizes)

    return joined.select("ids", "held", "lengths", "tokens", "c", "classes").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double")
