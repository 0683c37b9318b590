"""Language identification of words by a linear-chain conditional random field.

Words of a text are the chain. Features are affixes, character n-grams, the whole word and membership in the lexicon of
each language; transitions between labels are learned, so a text may switch languages. Marginals come from
forward-backward over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .tokens import MIX, CodeWords, mix

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Words of a language's lexicon: its most frequent ones in the training sample.
LEXICON = 1000
#: Words of a piece of a chain; pieces of all chains run side by side.
PIECE = 64


def _hash(kind: int, *codes: np.ndarray) -> np.ndarray:
    out = np.full(len(codes[0]), kind * int(MIX) % 2**64, np.uint64)
    for c in codes:
        out = mix(out + c * MIX + np.uint64(1))
    return out % np.uint64(BUCKETS)


def word_features(words: CodeWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every word ``<...>``: (n-grams of 2 and 3 signs end to end, how many per word, whole form and affixes
    of 2 to 4 signs, one column each)."""
    size = words.stop - words.start + 2
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - begin[owner]
    source = np.clip(words.start[owner] + inner - 1, 0, len(words.codes) - 1)
    c = words.codes[source].astype(np.uint64)
    c[begin], c[begin + size - 1] = ord("<"), ord(">")
    c = np.append(c, np.zeros(3, np.uint64))
    two = _hash(2, c[:-4], c[1:-3]) if len(c) > 4 else np.zeros(0, np.uint64)
    three = _hash(3, c[:-5], c[1:-4], c[2:-3]) if len(c) > 5 else np.zeros(0, np.uint64)
    # A word of n signs has n - 1 pairs, then n - 2 triples.
    count = 2 * size - 3
    first = np.cumsum(count) - count
    grams = np.empty(int(count.sum()), np.int64)
    a = np.flatnonzero(inner < size[owner] - 1)
    grams[first[owner[a]] + inner[a]] = two[a]
    a = np.flatnonzero(inner < size[owner] - 2)
    grams[first[owner[a]] + size[owner[a]] - 1 + inner[a]] = three[a]
    end = begin + size
    whole = [(words.hashes() % np.uint64(BUCKETS)).astype(np.int64)]
    for n in (2, 3, 4):
        # A word with fewer signs has only those it has.
        whole.append(_hash(10 + n, *[np.where(k < size, c[begin + k], np.uint64(0)) for k in range(n)]).astype(np.int64))
        whole.append(_hash(20 + n, *[np.where(k < size, c[np.maximum(end - 1 - k, 0)], np.uint64(0)) for k in range(n)]).astype(np.int64))
    return grams, count, np.stack(whole, 1)


@dataclass
class Model:
    """``labels`` in order, emission weights (label by bucket, then one bucket per lexicon), transition scores between
    labels, and the lexicons: word hashes in order and, a column for each label, whether its lexicon has the word."""

    labels: list[str]
    emission: np.ndarray
    transition: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray

    def members(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, label) of every hit in a lexicon."""
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        hit = np.flatnonzero(self.lexicon[at] == hashes)
        word, label = np.nonzero(self.member[at[hit]])
        return hit[word], label

    def emissions(self, words: CodeWords) -> np.ndarray:
        """Score of each label at each word."""
        grams, count, whole = word_features(words)
        first = np.cumsum(count) - count
        word, member = self.members(words.hashes())
        out = np.empty((len(count), len(self.labels)), np.float32)
        for k, weight in enumerate(self.emission):
            out[:, k] = np.add.reduceat(weight[grams], first) + weight[whole].sum(axis=1) + np.bincount(word, weight[BUCKETS + member], len(count))
        return out


def _unit(x: np.ndarray, axis: int | tuple[int, ...] = 1) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Forward-backward over many chains laid end to end, none of them empty.

    Chains are cut into pieces. What a piece does to a message is one product of matrices, so messages first go from
    piece to piece, then all pieces run side by side, longest first: a long text takes no longer than many short ones.
    """
    k, move = scores.shape[1], np.exp(transition).astype(np.float32)
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)) + np.float32(1e-30)
    parts = -(-lengths // piece)
    ends = np.cumsum(parts)
    chain = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(chain)) - (ends - parts)[chain]
    start = (np.cumsum(lengths) - lengths)[chain] + nth * piece
    size = np.minimum(piece, lengths[chain] - nth * piece)
    enter, leave = np.ones((len(chain), k), np.float32), np.ones((len(chain), k), np.float32)
    several = np.flatnonzero(parts[chain] > 1)
    if len(several):
        several = several[np.argsort(-size[several], kind="stable")]
        product = np.tile(np.eye(k, dtype=np.float32), (len(several), 1, 1))
        for t in range(int(size[several[0]])):
            n = int(np.searchsorted(-size[several], -t, "left"))
            moved = (product[:n].reshape(-1, k) @ move).reshape(n, k, k) if t else np.where((nth[several] > 0)[:, None, None], move, product)
            product[:n] = _unit(moved[:n] * potential[start[several[:n]] + t][:, None, :], (1, 2))
        of = np.empty(len(chain), np.int64)
        of[several] = np.arange(len(several))
        for j in range(1, int(parts.max())):
            at = (ends - parts)[parts > j] + j
            enter[at] = _unit(np.einsum("nk,nkl->nl", enter[at - 1], product[of[at - 1]]))
        for j in range(int(parts.max()) - 1, 0, -1):
            at = (ends - parts)[parts > j] + j
            leave[at - 1] = _unit(np.einsum("nkl,nl->nk", product[of[at]], leave[at]))
    order = np.argsort(-size, kind="stable")
    size, start, nth, enter, leave = size[order], start[order], nth[order], enter[order], leave[order]
    running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
    forward = np.empty_like(potential)
    state = np.where((nth > 0)[:, None], enter @ move, np.float32(1))
    for t, n in enumerate(running):
        at = start[:n] + t
        state[:n] = forward[at] = _unit((state[:n] @ move if t else state[:n]) * potential[at])
    state = leave
    for t in range(len(running) - 1, -1, -1):
        at = start[: running[t]] + t
        if t + 1 < len(running):
            n = running[t + 1]
            state[:n] = _unit((state[:n] * potential[at[:n] + 1]) @ move.T)
        forward[at] = _unit(forward[at] * state[: len(at)])
    return forward


def train(texts: list[str], langs: list[str], rounds: int = 6, span: int = 48, seed: int = 7, rate: float = 0.2, most: int = 2000, lexicon: int = LEXICON) -> Model:
    """Fit by AdaGrad on the conditional likelihood of spans that are joined across languages.

    A document's language is the label of each of its words; chains of one to three spans of different documents give
    the switches that the transitions are learned from. At most ``most`` spans of a language are drawn from the sample,
    however few another language has. The lexicon of a language has the ``lexicon`` words that occur in it most often,
    twice at least, ties by hash.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    k = len(labels)
    words = CodeWords(texts, "alpha")
    hashes = words.hashes()
    label_of = np.repeat(np.array([labels.index(x) for x in langs], np.int64), words.counts)
    chosen = []
    for label in range(k):
        own, n = np.unique(hashes[label_of == label], return_counts=True)
        chosen.append(own[np.lexsort((own, -n))][:lexicon][np.sort(-n)[:lexicon] <= -2])
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *chosen]))
    model = Model(labels, np.zeros((k, BUCKETS + k), np.float32), np.zeros((k, k), np.float32), known, np.stack([np.isin(known, c) for c in chosen], 1) if k else np.zeros((0, 0), bool))
    ends = np.cumsum(words.counts)
    spans = [(a, min(a + span, int(e)), labels.index(x)) for e, n, x in zip(ends, words.counts, langs, strict=True) for a in range(int(e - n), int(e), span)]
    if k < 2 or not spans:
        return model
    kept = []
    for label in range(k):
        own = [p for p in spans if p[2] == label]
        kept += [own[i] for i in rng.permutation(len(own))[:most]]
    used = np.unique(np.concatenate([np.arange(a, b) for a, b, _ in kept]))
    # Features of each different word once, some thousand words at a time.
    different, at, which = np.unique(hashes[used], return_index=True, return_inverse=True)
    order = np.argsort(at)  # by first place, as hashes of words are taken from left to right
    different, at, which = different[order], at[order], np.argsort(order)[which]
    made = [word_features(_take(words, used[at[i : i + 8192]])) for i in range(0, len(at), 8192)]
    grams, count, whole = (np.concatenate(x) for x in zip(*made, strict=True))
    hit, member = model.members(different)
    extra = np.bincount(hit, minlength=len(different))
    total = count + whole.shape[1] + extra
    first = np.cumsum(total) - total
    flat = np.empty(int(total.sum()), np.int64)
    owner = np.repeat(np.arange(len(different)), count)
    flat[first[owner] + np.arange(len(grams)) - (np.cumsum(count) - count)[owner]] = grams
    for j in range(whole.shape[1]):
        flat[first + count + j] = whole[:, j]
    flat[(first + count + whole.shape[1])[hit] + np.arange(len(hit)) - (np.cumsum(extra) - extra)[hit]] = BUCKETS + member
    weight = np.zeros((BUCKETS + k, k), np.float32)
    sq_e, sq_t = np.full_like(weight, 1e-4), np.full_like(model.transition, 1e-4)
    for _ in range(rounds):
        order = rng.permutation(len(kept))
        at = 0
        while at < len(order):
            chains: list[list[tuple[int, int, int]]] = []
            for n in rng.integers(1, 4, 128).tolist():
                chains.append([kept[i] for i in order[at : at + n]])
                at += n
            chains = [c for c in chains if c]
            place = which[np.searchsorted(used, np.concatenate([np.arange(a, b) for c in chains for a, b, _ in c]))]
            gold = np.concatenate([np.full(b - a, label) for c in chains for a, b, label in c])
            lengths = np.array([sum(b - a for a, b, _ in c) for c in chains])
            width = total[place]
            begin = np.cumsum(width) - width
            some = flat[np.arange(int(width.sum())) + np.repeat(first[place] - begin, width)]
            owner = np.repeat(np.arange(len(place)), width)
            scores = np.add.reduceat(weight[some], begin, axis=0)
            post = marginals(scores, lengths, model.transition)
            grad = -post
            grad[np.arange(len(place)), gold] += 1
            buckets, where = np.unique(some, return_inverse=True)
            g = np.stack([np.bincount(where, grad[owner, j], len(buckets)) for j in range(k)], 1).astype(np.float32)
            g -= 1e-3 * weight[buckets]
            sq_e[buckets] += g * g
            weight[buckets] += rate * g / np.sqrt(sq_e[buckets])
            inner = np.ones(len(place), bool)
            inner[np.cumsum(lengths) - 1] = False
            i = np.flatnonzero(inner)
            # Expected moves from neighbouring marginals and the move scores, normalised per position.
            joint = post[i][:, :, None] * np.exp(model.transition)[None] * post[i + 1][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True) + 1e-30
            g = -joint.sum(axis=0)
            np.add.at(g, (gold[i], gold[i + 1]), 1)
            sq_t += g * g
            model.transition += (rate * g / np.sqrt(sq_t)).astype(np.float32)
    model.emission = np.ascontiguousarray(weight.T)
    return model


def _take(words: CodeWords, some: np.ndarray) -> CodeWords:
    """The same texts with only some of their words, for their features."""
    out = CodeWords.__new__(CodeWords)
    out.codes, out.start, out.stop = words.codes, words.start[some], words.stop[some]
    return out


def sample(docs: DataFrame, per_language: int, max_languages: int, id_column: str, text: str, lang: str) -> DataFrame:
    """About ``per_language``, at most that many, labelled texts of each language, by a hash; the ``max_languages``
    languages with the most texts."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    sizes = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(max_languages)
    place = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("sample")), F.lit(1_000_000)) / F.lit(1e6)
    picked = labelled.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), place.alias("_p")).join(F.broadcast(sizes), "_lang")
    picked = picked.where(F.col("_p") * F.col("_n") < per_language)
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_p", F.xxhash64("_text")))
    return picked.withColumn("_nth", nth).where(F.col("_nth") <= per_language).select("_text", "_lang", "_p")


def fit(docs: DataFrame, per_language: int = 400, max_languages: int = 64, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on a bounded sample of labelled rows: at most ``per_language`` texts of each of the ``max_languages``
    languages with the most texts reach the driver; further languages are not learned."""
    rows = sample(docs, per_language, max_languages, id_column, text, lang).orderBy("_p", "_lang").select("_text", "_lang").toLocalIterator()
    texts, langs = [], []
    for r in rows:
        texts.append(r["_text"])
        langs.append(r["_lang"])
    return train(texts, langs)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (``["doc_id"]`` unless given) of every row with ``lang_pred string`` and ``score double``.

    ``score`` is the mean marginal of the winning label over all words of the text; ties go to the first label.
    A word is a run of letters. A text that is null or has no letter is ``und`` with score 0; so is every text if nothing
    could be learned.
    Repeated rows stay; an empty table gives no rows. No shuffle; texts are read whole.
    """
    keep = ["doc_id"] if keep is None else keep
    # The text is moved once where it is kept too.
    at = keep.index(text) if text in keep else len(keep)
    source = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows, one column per label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in slices(batch.column(at), 1 << 18):
                part = batch.slice(a, b - a)
                words = CodeWords(part.column(at).to_pylist(), "alpha")
                langs, best = [UNKNOWN] * len(part), np.zeros(len(part))
                full = np.flatnonzero(words.counts)
                if m.labels and len(full):
                    lengths = words.counts[full]
                    post = marginals(m.emissions(words), lengths, m.transition)
                    mean = np.add.reduceat(post, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]
                    best[full] = np.minimum(1.0, mean.max(axis=1))
                    for i, label in zip(full.tolist(), mean.argmax(axis=1).tolist(), strict=True):
                        langs[i] = m.labels[label]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs), pa.array(best, pa.float64())], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{fields}{', ' if keep else ''}lang_pred string, score double")
