"""Language ID: linear-chain conditional random field over words.

Words are parted by white space of any script; one of more than ``PIECE`` characters (as whole passages are in scripts without
spaces) is cut into pieces of that many, each a word of the chain, so that no character is left out. A word's features are its affixes (1 to 3 characters), its character 2- and 3-grams with word bounds, and itself (lexicon);
transitions between the languages of neighbouring words are learned with the features' weights by gradient steps on the
chains' log-likelihood. Forward-backward labels every word of every whole text with its languages' probabilities, so words of
code-switched texts are told apart; a document's language has the largest share of its words' probabilities.

The model is fitted on the driver on a bounded sample of the labelled rows: at most ``per_lang`` documents of each language (the first by a hash of
doc_id), of each a passage of at most ``train_chars`` characters (from a place that the hash sets, so documents of any length are learned from), and
of each language as many words as keep words times languages within ``TRAIN_CELLS``. Every language among the rows is learned; weights are
``2**feature_bits`` rows, fewer where that would pass ``MAX_WEIGHTS`` numbers. Prediction covers whole texts, under the transitions as fitted.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing could be
learned; ties go to the language first in code-point order; rows of one doc_id are predicted each; null doc_id is never trained
on and is not held out; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm._common import lean, read_table

FEATURE_BITS = 17
PER_LANG = 300
TRAIN_CHARS = 8_000
#: Bounds of the fit: words times languages, and numbers of the weights.
TRAIN_CELLS, MAX_WEIGHTS = 16_000_000, 1 << 24
#: Parts of a language in which its sample is chosen, so that no task ranks a language's whole table.
SALTS = 64
EPOCHS = 25
CHAIN = 128
BLOCK = 64
CACHE_WORDS = 200_000
BATCH_BYTES = 1 << 21
UNKNOWN = "und"
#: Characters of a word of the chain at most.
PIECE = 64
#: Odd multipliers of a character's place in a word; they come round again in longer ones.
_PLACE = np.random.default_rng(20240502).integers(0, 2**63, size=66, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def split_words(text: str) -> list[str]:
    """The words of a text, long ones in pieces."""
    own = text.split()
    if max(map(len, own), default=0) <= PIECE:
        return own
    return [w[i : i + PIECE] for w in own for i in range(0, len(w), PIECE)]


def features(words: list[str], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words, end to end; number of each word's): none for a word without a letter.

    A word is lower-cased and set between bounds.
    """
    lettered = np.array([any(map(str.isalpha, w)) for w in words], bool)
    bound = [f"<{w.lower()}>" for w, yes in zip(words, lettered.tolist()) if yes]
    n = np.zeros(len(words), np.int64)
    if not bound:
        return np.zeros(0, np.int64), n
    codes = np.frombuffer("".join(bound).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, bound), np.int64, len(bound))
    end = np.cumsum(size)
    begin = end - size
    n[lettered] = 2 * size + 4
    to = np.cumsum(2 * size + 4) - (2 * size + 4)
    out = np.empty(int((2 * size + 4).sum()), np.int64)

    def hashed(kind: int, *parts):
        h = np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for x in parts:
            h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(29))
        return (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int64)

    place = np.arange(len(codes)) - np.repeat(begin, size)
    out[to] = hashed(0, np.add.reduceat(codes * _PLACE[place % len(_PLACE)], begin))
    none = np.uint64(0)
    starts = [np.where(begin + 1 + j < end, codes[np.minimum(begin + 1 + j, end - 1)], none) for j in range(3)]
    stops = [np.where(end - 2 - j >= begin, codes[np.maximum(end - 2 - j, begin)], none) for j in range(3)]
    for k in range(3):
        out[to + 1 + k] = hashed(1 + k, *starts[: k + 1])
        out[to + 4 + k] = hashed(4 + k, *stops[: k + 1])
    left = np.repeat(size, size) - place  # characters from here to the word's end
    base = np.repeat(to + 7, size)
    for gram, skip in ((2, 0), (3, np.repeat(size - 1, size))):
        at = np.flatnonzero(left >= gram)
        out[(base + skip + place)[at]] = hashed(5 + gram, *(codes[at + j] for j in range(gram)))
    return out, n


def _scores(weights: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of each word's feature weights."""
    total = np.zeros((len(flat) + 1, weights.shape[1]))
    np.cumsum(weights[flat], axis=0, out=total[1:])
    end = np.cumsum(n)
    return total[end] - total[end - n]


def forward_backward(e: np.ndarray, a: np.ndarray, pi: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label probabilities (words x labels) of chains laid end to end.

    e: words' potentials; a: transition potentials; pi: first word's potentials; start: where a chain begins. Exact: blocks of words are
    multiplied out side by side, the products carry messages over block bounds, and a second sweep fills the blocks.
    """
    n, k = e.shape
    nb = -(-n // block)
    pad = nb * block - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(nb, block, k)
    s = np.concatenate([start, np.ones(pad, bool)]).reshape(nb, block)  # padding is no part of the last chain
    prod = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        step = prod @ a
        if s[:, t].any():
            at = np.flatnonzero(s[:, t])
            step[at] = prod[at].sum(axis=2, keepdims=True) * pi
        prod = step * e[:, t, None, :]
        prod /= prod.max(axis=(1, 2), keepdims=True)
    left, right = np.empty((nb, k)), np.empty((nb, k))
    x = np.full(k, 1.0 / k)
    for b in range(nb):
        left[b] = x
        x = x @ prod[b]
        x = x / x.sum()
    x = np.ones(k)
    for b in range(nb - 1, -1, -1):
        right[b] = x
        x = prod[b] @ x
        x = x / x.sum()
    alpha, out = np.empty((block, nb, k)), np.empty((nb, block, k))
    x = left
    for t in range(block):
        x = np.where(s[:, t, None], pi * x.sum(axis=1, keepdims=True), x @ a) * e[:, t]
        x = x / x.sum(axis=1, keepdims=True)
        alpha[t] = x
    x = right
    for t in range(block - 1, -1, -1):
        m = alpha[t] * x
        out[:, t] = m / m.sum(axis=1, keepdims=True)
        y = e[:, t] * x
        x = np.where(s[:, t, None], (y @ pi)[:, None], y @ a.T)
        x = x / x.sum(axis=1, keepdims=True)
    return out.reshape(-1, k)[:n]


class Tagger:
    """The fitted model: languages, feature weights, transition and first-word scores."""

    def __init__(self, langs: list[str], bits: int = FEATURE_BITS):
        self.langs, self.bits = langs, bits
        self.weights = np.zeros((1 << bits, len(langs)), np.float32)
        self.trans = np.zeros((len(langs), len(langs)))
        self.cache: dict[str, int] = {}

    def fit(self, texts: list[str], langs: list[int], epochs: int = EPOCHS, chain: int = CHAIN, rate: float = 0.5) -> "Tagger":
        """Gradient steps with per-weight rates (Adagrad) over all chains; neighbouring documents share chains, so switches are seen."""
        ids: dict[str, int] = {}
        seq, label = [], []
        for text, lang in zip(texts, langs):
            own = split_words(text)
            seq += [ids.setdefault(w, len(ids)) for w in own]
            label += [lang] * len(own)
        k = len(self.langs)
        m = len(seq) // chain
        if not seq:
            return self
        if m == 0:
            m, chain = 1, len(seq)
        seq = np.array(seq[: m * chain]).reshape(m, chain)
        gold = np.eye(k)[np.array(label[: m * chain]).reshape(m, chain)]
        flat, n = features(list(ids), self.bits)
        word_of = np.repeat(np.arange(len(n)), n)
        seen_trans = np.einsum("mti,mtj->ij", gold[:, :-1], gold[:, 1:])
        past_w, past_t = np.full(self.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
        total = seq.size
        for _ in range(epochs):
            score = _scores(self.weights, flat, n)
            e = np.exp(score - score.max(axis=1, keepdims=True))[seq]
            a = np.exp(self.trans)
            alpha, x = np.empty((chain, m, k)), np.full((m, k), 1.0 / k)
            for t in range(chain):
                x = (x @ a if t else x) * e[:, t]
                x = x / x.sum(axis=1, keepdims=True)
                alpha[t] = x
            x, expected, post = np.ones((m, k)), np.zeros((k, k)), np.empty((m, chain, k))
            for t in range(chain - 1, -1, -1):
                p = alpha[t] * x
                post[:, t] = p / p.sum(axis=1, keepdims=True)
                if t:
                    y = e[:, t] * x
                    pair = alpha[t - 1][:, :, None] * a * y[:, None, :]
                    expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    x = y @ a.T
                    x = x / x.sum(axis=1, keepdims=True)
            g_word = np.stack([np.bincount(seq.ravel(), (gold - post)[:, :, j].ravel(), len(n)) for j in range(k)], axis=1)
            g = np.stack([np.bincount(flat, g_word[word_of, j], len(self.weights)) for j in range(k)], axis=1) / total - 1e-7 * self.weights
            past_w += (g * g).astype(np.float32)
            self.weights += (rate * g / np.sqrt(past_w)).astype(np.float32) * (np.abs(g) > 0)
            gt = (seen_trans - expected) / total
            past_t += gt * gt
            self.trans += rate * gt / np.sqrt(past_t)
        return self

    def words(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(potentials, has letters) of words, through a bounded cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        if not cache:
            self.known = np.zeros((0, len(self.langs)))
            self.letters = np.zeros(0, bool)
        size = len(cache)
        at = np.array([cache.setdefault(w, len(cache)) for w in own], np.int64)
        if len(cache) > size:
            new = list(cache)[size:] if size == 0 else [w for w, i in zip(own, at.tolist()) if i >= size]
            new = list(dict.fromkeys(new))
            flat, n = features(new, self.bits)
            score = _scores(self.weights, flat, n)
            self.known = np.concatenate([self.known, np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30.0))])
            self.letters = np.concatenate([self.letters, n > 0])
        return self.known[at], self.letters[at]

    def tag(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: probabilities of its words' languages, and which words have letters."""
        lists = [split_words(t.decode("utf-8", "surrogatepass")) for t in texts]
        n = np.array([len(x) for x in lists], np.int64)
        at = np.r_[0, np.cumsum(n)]
        if not at[-1]:
            return [(np.zeros((0, len(self.langs))), np.zeros(0, bool))] * len(texts)
        e, letters = self.words([w for x in lists for w in x])
        start = np.zeros(at[-1], bool)
        start[at[:-1][n > 0]] = True
        a = np.exp(np.clip(self.trans - self.trans.max(), -60, 0))  # as fitted, but for one factor that all chains share
        post = forward_backward(e, a, np.full(len(self.langs), 1.0 / len(self.langs)), start)
        return [(post[i:j], letters[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out = []
        for post, letters in self.tag(texts) if self.langs else []:
            if letters.any():
                share = post[letters].mean(axis=0)
                best = int(share.argmax())
                out.append((self.langs[best], min(1.0, max(0.0, float(share[best])))))
            else:
                out.append((UNKNOWN, 0.0))
        return out or [(UNKNOWN, 0.0)] * len(texts)


def fit(labelled: DataFrame, per_lang: int = PER_LANG, train_chars: int = TRAIN_CHARS, bits: int = FEATURE_BITS) -> Tagger:
    """A tagger fitted on labelled (doc_id, text, lang): passages of at most per_lang documents of every language."""
    text = F.col("text").cast("string")
    rows = labelled.where(F.col("doc_id").isNotNull() & text.isNotNull() & F.col("lang").isNotNull()).select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    hashed = F.xxhash64("doc_id")
    # Ids are ranked first within salted parts of a language, then within it; only the chosen ones' passages move.
    ids = rows.select("doc_id", "lang")
    for parts in (F.pmod(hashed, F.lit(SALTS)), F.lit(0)):
        order = Window.partitionBy("lang", parts).orderBy(hashed, "doc_id")
        ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).drop("k")
    chosen = F.broadcast(ids.distinct())  # per_lang rows a language at most
    begin = F.pmod(hashed, F.greatest(F.length("text") - train_chars + 1, F.lit(1))).cast("int") + 1
    passages = rows.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", F.substring(F.col("text"), begin, F.lit(train_chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id", "text")
    took = passages.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
    got = sorted(map(tuple, took.select(hashed, "doc_id", "text", "lang").collect()))
    langs = sorted({r[3] for r in got})
    words = max(CHAIN, TRAIN_CELLS // max(1, len(langs)) ** 2)  # of a language
    left, texts, labels = dict.fromkeys(langs, words), [], []
    for _, _, t, lang in got:
        own = t.split()[: left[lang]]
        left[lang] -= len(own)
        texts.append(" ".join(own))
        labels.append(langs.index(lang))
    while bits > 10 and len(langs) << bits > MAX_WEIGHTS:
        bits -= 1
    return Tagger(langs, bits).fit(texts, labels)


def predict(docs: DataFrame, model: Tagger) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text)."""
    model.cache = {}
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x languages floats

    def run(batches):
        tagger = sent.value
        names = ["doc_id", "lang_pred", "score"]

        def rows(ids, texts):
            got = tagger.predict(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size > BATCH_BYTES:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def op2_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
