"""Operator 7: language identification by a linear-chain conditional random field.

Words are labelled with languages; a run of over LONGEST characters without
white space counts as several words, in training and prediction.  A word's features are its character
n-grams of 1 to 4 characters with word-boundary marks (those that hold a mark
are its affixes) and the word itself (the lexicon); all are hashed into one
weight table.  Transitions between neighbouring labels are learned with them.
A document's words are one chain; forward-backward gives each word's label
probabilities, and the document's language is the label with the greatest sum,
its score their mean.

The model is fitted on a bounded sample of labelled rows: at most
``sample_docs`` documents, of each one window of ``window`` words.  Training
chains switch between documents of different languages, so transitions are
learned for mixed texts.  Prediction reads whole texts, and only texts.

Null texts and texts without a letter get ``und`` with score 0, and so does
every text if nothing can be learned.  Repeated rows are predicted each; in
training they count as often as they are drawn.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query, worker_frees, worker_holds

BITS = 18
ORDERS = (1, 2, 3, 4)
CHUNK = 64                     # words of a chain that are stepped through side by side with other stretches
BATCH_CHARS = 750_000
SLICE_ROWS = 256               # rows whose texts a worker has as Python strings at once
SCORED = 8_000                 # words whose features are made at once: 40 bytes a feature for a while
CACHE = 150_000                # word scores that a worker keeps before it starts anew
UNDETERMINED = "und"
LONGEST = 40                   # characters of a word; a longer run, as in scripts without spaces, is cut into words

_STATE: dict = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def features(words: list[str]):
    """(indices, first index of each word): hashed features of the words, one stretch after the other."""
    import numpy as np

    marked = "".join("\x02" + w + "\x03" for w in words)
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    index, of = [], []
    h = np.zeros(len(code), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        n = len(code) - k + 1
        if n <= 0:
            break
        h = h[:n] * np.uint64(0x100000001B3) + code[k - 1:] * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(owner[:n] == owner[k - 1:])
        if k == 1:
            at = at[(code[at] != 2) & (code[at] != 3)]
        index.append(_slot(h[at] + np.uint64(k)))
        of.append(owner[at])
    place = np.arange(len(code)) - start[owner]
    whole = np.add.reduceat(code * (np.uint64(0xD6E8FEB86659FD93) ** (place.astype(np.uint64) + np.uint64(1))), start)
    index.append(_slot(whole))
    of.append(np.arange(len(words)))
    index, of = np.concatenate(index), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return index[order], np.searchsorted(of[order], np.arange(len(words)))


def words_of(text: str) -> list[str]:
    """The words of a text, for training and prediction: runs without white space, cut after each LONGEST characters."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def _slot(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def scores(words: list[str], weights):
    """Score of each label for each word: the mean weight of its features, scaled."""
    import numpy as np

    index, first = features(words)
    size = np.diff([*first, len(index)])
    return np.add.reduceat(weights[index], first, axis=0) / np.sqrt(size)[:, None]


def posteriors(emission, transition, chain_start):
    """Label probabilities of each word, and log Z of each chain, by forward-backward.

    ``emission`` (n, L) and ``transition`` (L, L) are log scores, ``chain_start``
    the first word of each chain.  Chains are cut into stretches of CHUNK
    words; products of the stretches' matrices carry the messages from stretch
    to stretch, so all stretches are stepped through at once.
    """
    import numpy as np

    n, labels = emission.shape
    size = np.diff([*chain_start, n])
    pieces = -(-size // CHUNK)
    chain = np.repeat(np.arange(len(size)), pieces)
    within = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.asarray(chain_start)[chain] + within * CHUNK
    length = np.minimum(CHUNK, size[chain] - within * CHUNK)
    top = emission.max(axis=1)
    grid = np.ones((len(chain), CHUNK, labels))
    step = np.arange(CHUNK)
    real = step[None, :] < length[:, None]
    grid[real] = np.exp(emission - top[:, None])              # stretches are in word order
    trans = np.exp(transition)
    eye = np.eye(labels)

    def move(m, t):                                           # m (stretches, ., labels): over word t
        out = (m @ trans) * grid[:, t, None, :]
        scale = out.sum(axis=(1, 2), keepdims=True)
        return np.where(real[:, t, None, None], out / scale, m), np.where(real[:, t], np.log(scale[:, 0, 0]), 0)

    whole, log_whole = np.broadcast_to(eye, (len(chain), labels, labels)).copy(), np.zeros(len(chain))
    for t in range(min(CHUNK, int(length.max(initial=0)))):
        whole, s = move(whole, t)
        log_whole += s
    # messages into each stretch, from the left and from the right
    left, log_left = np.full((len(chain), labels), 1.0 / labels), np.zeros(len(chain))
    right = np.full((len(chain), labels), 1.0)
    by_place = np.argsort(within, kind="stable")
    cuts = np.searchsorted(within[by_place], np.arange(within.max(initial=-1) + 2))
    for i in range(1, len(cuts) - 1):
        at = by_place[cuts[i]:cuts[i + 1]]
        m = np.einsum("ni,nij->nj", left[at - 1], whole[at - 1])
        s = m.sum(axis=1)
        left[at], log_left[at] = m / s[:, None], log_left[at - 1] + log_whole[at - 1] + np.log(s)
    for i in range(len(cuts) - 3, -1, -1):
        at = by_place[cuts[i]:cuts[i + 1]]
        at = at[np.append(chain[1:], -1)[at] == chain[at]]
        m = np.einsum("nij,nj->ni", whole[at + 1], right[at + 1])
        right[at] = m / m.sum(axis=1, keepdims=True)
    # inside the stretches; the first word of a chain has a uniform message
    alpha, now = np.empty_like(grid), left
    log_z = log_left + log_whole
    for t in range(CHUNK):
        now = np.where(real[:, t, None], (now @ trans) * grid[:, t], now)
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    beta, now = np.empty_like(grid), right
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = now
        now = np.where(real[:, t, None], (grid[:, t] * now) @ trans.T, now)
        now = now / now.sum(axis=1, keepdims=True)
    p = (alpha * beta)[real]
    last = np.append(chain[1:] != chain[:-1], True) if len(chain) else np.zeros(0, bool)
    end = np.einsum("ni,nij->nj", left[last], whole[last]).sum(axis=1)
    z = log_z[last] + np.log(end) + np.add.reduceat(top, chain_start) if n else np.zeros(0)
    b_prev = (alpha, beta, real)
    return p / p.sum(axis=1, keepdims=True), z, b_prev


def _pair_counts(alpha, beta, real, grid_emission, trans, chain_of):
    """Expected label pairs of neighbouring words, from normalised messages."""
    import numpy as np

    a, b = alpha[real], (beta[real] * grid_emission)
    inside = np.flatnonzero(chain_of[1:] == chain_of[:-1])
    joint = a[inside][:, :, None] * trans[None] * b[inside + 1][:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(windows: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.25, seed: int = 7):
    """(labels, weights, transitions) of the field, from (label, words) windows.

    Chains join a few windows, mostly of different labels; full-batch gradient
    of the log likelihood with per-weight step sizes.
    """
    import numpy as np

    labels = sorted({label for label, _ in windows})
    if not labels:
        return [], None, None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    words, gold, chain_start, i = [], [], [], 0
    while i < len(order):
        take = int(rng.integers(1, 4))
        chain_start.append(len(words))
        for j in order[i:i + take]:
            label, own = windows[j]
            words += own
            gold += [labels.index(label)] * len(own)
        i += take
    gold = np.array(gold)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(words))}
    of = np.array([vocabulary[w] for w in words])
    index, first = features(list(vocabulary))
    size = np.diff([*first, len(index)])
    owner, scale = np.repeat(np.arange(len(vocabulary)), size), np.sqrt(size)[:, None]
    L = len(labels)
    weights, trans = np.zeros((1 << BITS, L)), np.zeros((L, L))
    g2, t2 = np.full((1 << BITS, L), 1e-3), np.full((L, L), 1e-3)
    chain_of = np.repeat(np.arange(len(chain_start)), np.diff([*chain_start, len(words)]))
    inside = np.flatnonzero(chain_of[1:] == chain_of[:-1])
    seen = np.zeros((L, L))
    np.add.at(seen, (gold[inside], gold[inside + 1]), 1)
    one = np.eye(L)[gold]
    for _ in range(rounds):
        emission = (np.add.reduceat(weights[index], first, axis=0) / scale)[of]
        p, _, (alpha, beta, real) = posteriors(emission, trans, chain_start)
        by_word = np.zeros((len(vocabulary), L))
        np.add.at(by_word, of, one - p)
        by_word /= scale
        grad = np.stack([np.bincount(index, by_word[owner, k], 1 << BITS) for k in range(L)], axis=1) - 1e-2 * weights
        g2 += grad ** 2
        weights += rate * grad / np.sqrt(g2)
        grid = np.exp(emission - emission.max(axis=1, keepdims=True))
        grad = seen - _pair_counts(alpha, beta, real, grid, np.exp(trans), chain_of) - 1e-2 * trans
        t2 += grad ** 2
        trans += 0.5 * rate * grad / np.sqrt(t2)
    return labels, weights.astype(np.float32), trans


def _windows(n: int):
    """One window of at most n words, from a place that depends on the text, of each text."""

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            lang, words = [], []
            for label, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = words_of(text)
                at = zlib.crc32(text.encode()) % max(1, len(own) - n + 1)
                if own:
                    lang.append(label)
                    words.append(own[at:at + n])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.list_(pa.string()))],
                                             names=["lang", "words"])

    return run


def learn(docs: DataFrame, sample_docs: int = 1600, window: int = 60):
    """Model from labelled rows (doc_id, text, lang) that are not held out.

    Each language gives about the same number of documents, drawn by a hash of
    doc_id; at most ``sample_docs`` windows of ``window`` words reach the driver.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.col("n").desc(), "lang").limit(sample_docs).collect()}
    if not sizes:
        return [], None, None
    each = sample_docs / len(sizes)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("lang") == label, F.lit(min(1.0, each / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) / 1_000_003 < share
    rows = train.where(drawn).select("lang", "text").limit(2 * sample_docs).mapInArrow(
        _windows(window), "lang string, words array<string>").collect()
    return fit(sorted((r.lang, r.words) for r in rows))


def _predict(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        labels, weights, trans = model.value
        letter = regex.compile(r"\p{L}").search
        if worker_holds(_STATE).get("model") is not model:
            _STATE.update(model=model, at={}, rows=np.zeros((0, max(1, len(labels)))))

        def predicted(texts):
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            which = [i for i, t in enumerate(texts) if t and labels and letter(t)]
            split = [words_of(texts[i]) for i in which]
            if not which:
                return lang, score
            at = _STATE["at"]
            new = list({w for ws in split for w in ws}.difference(at))
            if len(at) + len(new) > CACHE:
                at.clear()
                _STATE["rows"] = _STATE["rows"][:0]
                new = list({w for ws in split for w in ws})
            if new:
                at.update(zip(new, range(len(at), len(at) + len(new))))
                _STATE["rows"] = np.concatenate([_STATE["rows"], *(scores(new[i:i + SCORED], weights) for i in range(0, len(new), SCORED))])
            of = np.fromiter((at[w] for ws in split for w in ws), np.int64)
            size = np.array([len(ws) for ws in split])
            start = np.cumsum(size) - size
            p = posteriors(_STATE["rows"][of], trans, start)[0]
            mean = np.add.reduceat(p, start, axis=0) / size[:, None]
            for i, k, s in zip(which, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                lang[i], score[i] = labels[k], min(1.0, s)
            return lang, score

        for batch in batches:
            column, langs, marks, group, chars = batch.column("text"), [], [], [], 0
            for first in range(0, batch.num_rows, SLICE_ROWS):
                for text in column.slice(first, SLICE_ROWS).to_pylist():
                    group.append(text)
                    chars += len(text or "")
                    if chars > BATCH_CHARS:
                        a, b = predicted(group)
                        langs, marks, group, chars = langs + a, marks + b, [], 0
            a, b = predicted(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns)]
                + [pa.array(langs + a, pa.string()), pa.array(marks + b, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])
        worker_frees(_STATE)                  # few of its words come again in other tasks

    return run


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with lang_pred and score, from its column text alone.

    Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2**BITS weights a label, a fixed size
    return docs.mapInArrow(_predict(shared), f"{schema}, lang_pred string, score double")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
