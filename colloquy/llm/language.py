"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its letter n-grams and the word itself (the lexicon), hashed. Their weights and the
transitions between languages are learned together on word sequences, pure and code-switched, by the gradient that
forward-backward gives. A text's words are labelled by the same forward-backward pass over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._scratch import lean

SLOTS = 1 << 18
WIDTH = 24
#: The messages are scaled at every so many words.
SCALED = 4
#: Most pieces whose scores a task keeps.
KEPT = 60_000
#: What is worked out at once: new words, texts, and words of padded texts.
WORDS, TEXTS, PADDED = 4_000, 200, 100_000
UNKNOWN = "und"


def cut_long(piece: str) -> list[str]:
    """A blank-separated piece, with more letters than a word holds as several: text without blanks counts whole."""
    if len(piece) <= WIDTH:
        return [piece]
    word = word_of(piece)
    return [word[i : i + WIDTH] for i in range(0, len(word), WIDTH)]


def pieces_of(text: str) -> list[str]:
    """The blank-separated pieces of a text, long ones cut."""
    pieces = text.split()
    if max(map(len, pieces), default=0) <= WIDTH:
        return pieces
    return [q for p in pieces for q in cut_long(p)]


def word_of(piece: str) -> str:
    """The letters of a blank-separated piece, in lower case."""
    low = piece.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, which are used) for each word of at most WIDTH letters."""
    n = len(words)
    letters = np.array([f"\x02{w}\x03" for w in words], dtype=f"U{WIDTH + 2}").view(np.uint32).reshape(n, WIDTH + 2).astype(np.uint64)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = (letters[:, :-1] * a) ^ (letters[:, 1:] * b + np.uint64(2))
    three = two[:, :-1] ^ (letters[:, 2:] * c + np.uint64(3))
    length = (letters > 0).sum(1)
    at = np.arange(WIDTH + 2)
    ends = []
    for size in (3, 4, 5):  # affixes of two, three and four letters with their border
        front = np.zeros(n, np.uint64)
        back = np.zeros(n, np.uint64)
        for i in range(size):
            front = (front ^ letters[:, i]) * a + b
            back = (back ^ letters[np.arange(n), np.maximum(length - size + i, 0)]) * c + a
        ends += [front, back]
    whole = np.zeros(n, np.uint64)
    for i in range(WIDTH + 2):
        whole = (whole ^ letters[:, i]) * b + c
    codes = np.column_stack([two, three, *ends, whole])
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    slots = (codes >> np.uint64(64 - 18)).astype(np.int32)
    used = np.column_stack([at[None, 1:] < length[:, None], at[None, 2:] < length[:, None], *(np.broadcast_to((length >= s)[:, None], (n, 2)) for s in (3, 4, 5)), np.ones((n, 1), bool)])
    return slots, used


@dataclass
class Crf:
    """Labels in order, feature weights, transition scores and start scores."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, (n, labels)."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), WORDS):
            slots, used = features(words[i : i + WORDS])
            total = np.zeros((len(slots), len(self.labels)), np.float32)
            for f in range(slots.shape[1]):
                total += self.weights[slots[:, f]] * used[:, f, None]
            out[i : i + WORDS] = total / np.sqrt(used.sum(1))[:, None]
        return out

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of each word, for padded sequences (sequences, words, labels)."""
        alpha, beta, _, _ = forward_backward(emissions, lengths, self.moves, self.start)
        gamma = alpha * beta
        return gamma / np.maximum(gamma.sum(2, keepdims=True), 1e-30)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Scaled forward and backward messages, the word potentials and the transition potentials."""
    many, steps, labels = emissions.shape
    potential = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(potential), np.ones_like(potential)
    alpha[:, 0] = np.exp(start - start.max())[None] * potential[:, 0]
    for t in range(1, steps):
        now = (alpha[:, t - 1] @ move) * potential[:, t]
        alpha[:, t] = now if t % SCALED else now / now.sum(1, keepdims=True)
    back = np.ascontiguousarray(move.T)
    ended = int(lengths.min())
    for t in range(steps - 2, -1, -1):
        now = (beta[:, t + 1] * potential[:, t + 1]) @ back
        if not t % SCALED:
            now /= now.sum(1, keepdims=True)
        beta[:, t] = now if t + 1 < ended else np.where((t + 1 < lengths)[:, None], now, 1.0)
    return alpha, beta, potential, move


def train(texts: list[tuple[str, str]], words_per_text: int = 120, sequence: int = 24, rounds: int = 6, seed: int = 7) -> Crf:
    """Learns from (label, text) rows. Half of the sequences are pure, half switch between two texts."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, _ in texts})
    number = {label: i for i, label in enumerate(labels)}
    k = max(1, len(labels))
    model = Crf(labels, np.zeros((SLOTS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    vocabulary: dict[str, int] = {}
    runs: list[tuple[int, list[int]]] = []
    for label, text in texts:
        words = [w for p in pieces_of(text) if (w := word_of(p))][:words_per_text]
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        runs += [(number[label], ids[i : i + sequence]) for i in range(0, len(ids), sequence)]
    if k < 2 or not runs:
        return model
    slots, used = features(list(vocabulary))
    share = (used / np.sqrt(used.sum(1))[:, None]).astype(np.float32)
    pad_x, pad_y, size = [], [], []
    for y, ids in runs:
        other_y, other = runs[rng.integers(len(runs))]
        at = int(rng.integers(1, sequence)) if rng.random() < 0.5 else sequence
        x = ids[:at] + other[: max(0, sequence - at)]
        pad_x.append(x + [0] * (sequence - len(x)))
        pad_y.append([y] * len(ids[:at]) + [other_y] * (len(x) - len(ids[:at])) + [0] * (sequence - len(x)))
        size.append(len(x))
    x, y, size = np.array(pad_x), np.array(pad_y), np.array(size)
    seen = np.full((SLOTS, k), 1e-3, np.float32)
    seen_moves = np.full((k, k), 1e-3, np.float32)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            pick = order[i : i + 128]
            bx, by, bn = x[pick], y[pick], size[pick]
            steps = int(bn.max())
            bx, by = bx[:, :steps], by[:, :steps]
            mask = np.arange(steps)[None] < bn[:, None]
            words, back = np.unique(bx, return_inverse=True)
            back = back.reshape(bx.shape)
            part = (model.weights[slots[words]] * share[words][:, :, None]).sum(1)
            alpha, beta, potential, move = forward_backward(part[back], bn, model.moves, model.start)
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-30)
            error = (np.eye(k, dtype=np.float32)[by] - gamma) * mask[:, :, None]
            by_word = np.zeros((len(words), k), np.float32)
            np.add.at(by_word, back.ravel(), error.reshape(-1, k))
            flat = slots[words].ravel()
            step = np.stack([np.bincount(flat, (share[words] * by_word[:, c, None]).ravel(), SLOTS) for c in range(k)], 1).astype(np.float32) / len(pick)
            touched = np.flatnonzero(np.abs(step).sum(1))
            seen[touched] += step[touched] ** 2
            model.weights[touched] += 0.3 * step[touched] / np.sqrt(seen[touched])
            both = mask[:, 1:]
            pair = alpha[:, :-1, :, None] * move[None, None] * (potential[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-30)
            real = np.zeros((k, k), np.float32)
            np.add.at(real, (by[:, :-1][both], by[:, 1:][both]), 1)
            step = (real - pair[both].sum(0)) / len(pick)
            seen_moves += step**2
            model.moves += (0.2 * step / np.sqrt(seen_moves)).astype(np.float32)
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts_per_label: int = 200, chars_per_text: int = 4000, max_labels: int = 200) -> Crf:
    """Fits on ``texts_per_label`` different texts of each label, or all if there are fewer: those with the smallest
    hashes, so the same rows whatever their order. Of each the first ``chars_per_text`` characters are fetched, of which
    ``train`` reads 120 words: a bounded sample, whatever the table's size. Null texts or labels are left out; without
    rows, the model knows no label. More than ``max_labels`` labels are an error.
    """
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null and trim(text) != ''")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("slot", F.pmod("hash", F.lit(1 << 30)))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return train([])
    # about twice the texts wanted, of which the smallest hashes are taken; copies count once
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2 * texts_per_label + 50) / n))])
    some = rows.where(F.col("slot") < share[F.col("lang")] * (1 << 30))
    some = some.groupBy("lang", "slot", "hash").agg(F.min(F.substring("text", 1, chars_per_text)).alias("text"))
    some = some.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("slot", "hash"))).where(F.col("number") <= texts_per_label)
    return train(sorted((r["lang"], r["text"]) for r in some.select("lang", "text").collect()))


class _Pieces(dict):
    """Numbers of blank-separated pieces by their word, 0 for those without a letter; new words wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        word = word_of(piece)
        number = self.words.get(word, 0) if word else 0
        if word and not number:
            number = self.words[word] = len(self.words) + 1
            self.new.append(word)
        self[piece] = number
        return number


class _Tagger:
    """Emission scores of words, kept while a task runs: workers are reused, and another stage needs their memory."""

    def __init__(self, model: Crf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.pieces = _Pieces()
        self.table = np.zeros((1, len(self.model.labels)), np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.pieces) > KEPT:
            self.clear()
        get = self.pieces.__getitem__
        out = [np.array(list(map(get, pieces)), np.int32) for pieces in texts]
        if self.pieces.new:
            self.table = np.concatenate([self.table, self.model.scores(self.pieces.new)])
            self.pieces.new.clear()
        return [x[x > 0] for x in out]

    def documents(self, texts: list[str]) -> list[np.ndarray]:
        """Label probabilities of each word of each text."""
        if not self.model.labels:
            return [np.zeros((0, 0), np.float32)] * len(texts)
        words = self.numbers([pieces_of(t) for t in texts])
        out: list[np.ndarray] = [np.zeros((0, len(self.model.labels)), np.float32)] * len(texts)
        order = sorted((i for i in range(len(words)) if len(words[i])), key=lambda i: len(words[i]))
        group: list[int] = []
        for i in order:
            if group and len(words[i]) * (len(group) + 1) > PADDED:
                self.group(group, words, out)
                group = []
            group.append(i)
        if group:
            self.group(group, words, out)
        return out

    def group(self, group, words, out) -> None:
        lengths = np.array([len(words[i]) for i in group])
        padded = np.zeros((len(group), lengths.max()), np.int32)
        for row, i in enumerate(group):
            padded[row, : lengths[row]] = words[i]
        gamma = self.model.posteriors(self.table[padded], lengths)
        for row, i in enumerate(group):
            out[i] = gamma[row, : lengths[row]]


def texts_of(batch: pa.RecordBatch, column: str, at: int) -> list[str]:
    """TEXTS of a batch's texts, as only so many are held as Python's."""
    return [t or "" for t in batch.column(column).slice(at, TEXTS).to_pylist()]


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """The language of every whole text: the label with the highest mean probability over its words, and that mean.

    ``und`` with score 0 if the text is null or has no letter, or the model knows no label. Ties go to the first label.
    With ``words``, also the label of each word in turn. Nothing is shuffled; ids may be null or repeated.
    """
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    fields = [("doc_id", kept.schema["doc_id"].dataType.simpleString()), ("lang_pred", "string"), ("score", "double")] + [("word_labels", "array<string>")] * words

    def run(batches):
        tagger = _Tagger(model)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                some = tagger.documents(texts_of(batch, "text", i))
                mean = [g.mean(0, dtype=np.float64) if len(g) and g.shape[1] else None for g in some]
                columns = [batch.column("doc_id").slice(i, TEXTS), pa.array([UNKNOWN if m is None else model.labels[int(m.argmax())] for m in mean], pa.string()), pa.array([0.0 if m is None else float(min(1.0, m.max())) for m in mean], pa.float64())]
                if words:
                    columns.append(pa.array([[model.labels[j] for j in g.argmax(1)] if m is not None else [] for g, m in zip(some, mean)], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    return kept.mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in fields))


def held_out(column: Column) -> Column:
    """Whether the id's fold is held out: crc32 of the id as text, modulo 5, is 0. A null id isn't."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def cross_check(docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out and predicts every row: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(docs["doc_id"]) & docs["doc_id"].isNotNull()))
    out = predict(docs, model)
    return out.select("doc_id", held_out(out["doc_id"]).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Crf, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows, columns as they are, whose text has a letter and whose words' likeliest languages have at least this mean
    probability: words of several languages that are each sure count as known."""
    names = docs.columns

    def run(batches):
        tagger = _Tagger(model)
        for batch in batches:
            keep = [len(g) > 0 and g.shape[1] > 0 and float(g.max(1).mean(dtype=np.float64)) >= least_score for i in range(0, batch.num_rows, TEXTS) for g in tagger.documents(texts_of(batch, text_col, i))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return docs.mapInArrow(lean(run), docs.schema)
