"""Text decoded with the wrong character encoding: found by a hidden Markov model, restored by the inverse transform.

The model has a clean state, a state for what can't be restored (U+FFFD), and one state for each pair (encoding the bytes
were in, encoding they were read in). It labels the characters of a word. Emissions are conditional on the character
before, over classes of characters; nothing is labelled by hand:

* what a pair's state emits is learnt by garbling the corpus's own words with that pair;
* what the clean state emits is what the corpus holds, less the share that garbling explains.

A pair's state can only be left or entered at a cost, a word's inverse image counts as evidence too: a state whose inverse
transform turns the word into one that the corpus knows better gains by the ratio of the two counts, one that can't invert
the word pays. The labelled span gets its state's inverse transform; a last exact check asks that the inverse exists.

Distinct words are labelled, not rows. The emission tables have at most states x classes x classes cells whatever the corpus,
so they may be collected and sent to the executors.
"""

from __future__ import annotations

import codecs
import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..skew import join_counted

#: (bytes were in, were read as, times): the pairs that are modelled.
PAIRS = [
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "mac_roman", 1),
    ("cp1252", "cp1251", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("mac_roman", "cp1252", 1), ("cp1251", "cp1252", 1), ("koi8_r", "cp1252", 1), ("cp1253", "cp1252", 1),
    ("cp932", "cp1252", 1), ("cp932", "cp437", 1), ("cp932", "cp850", 1), ("euc_jp", "cp1252", 1),
]
LOST = "�"
#: Words longer than this are labelled in windows of this many characters, with the whole word's evidence.
WINDOW = 128


@lru_cache(maxsize=None)
def read_table(codec: str) -> str:
    """What a tolerant reader makes of each byte: bytes the codec leaves open come out as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


class _Bytes(dict):
    """Characters to those of the same number as their byte; others to one that isn't a byte's."""

    def __missing__(self, key: int) -> int:
        return 0xFFFF


@lru_cache(maxsize=None)
def _byte_of(codec: str) -> _Bytes:
    back = _Bytes()
    for b, c in reversed(list(enumerate(read_table(codec)))):
        back[ord(c)] = b
    for b in range(0x80, 0xA0):  # the same bytes read by a reader that keeps controls
        back.setdefault(b, b)
    return back


def garble(text: str, pair: tuple[str, str, int]) -> str | None:
    """What a reader sees who takes the wrong encoding; None if the text can't be written in the first one."""
    true, wrong, times = pair
    table = read_table(wrong)
    for _ in range(times):
        try:
            text = codecs.charmap_decode(text.encode(true), "strict", table)[0]
        except UnicodeEncodeError:
            return None
    return text


def restore(text: str, pair: tuple[str, str, int]) -> str | None:
    """The inverse of :func:`garble`; None if there is none."""
    true, wrong, times = pair
    back = _byte_of(wrong)
    for _ in range(times):
        try:
            text = text.translate(back).encode("latin-1").decode(true)
        except UnicodeError:
            return None
    return text


@lru_cache(maxsize=1)
def classes() -> dict[str, int]:
    """Characters with a class of their own: those that the readers can produce, and Latin letters with marks."""
    chars = {c for codec in ("cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "mac_roman") for c in read_table(codec) if ord(c) > 0x7F}
    chars |= {chr(i) for i in range(0x80, 0x250)} | {LOST}
    return {c: 12 + i for i, c in enumerate(sorted(chars))}


def class_of(c: str) -> int:
    """0 is the edge of a word, 1 to 11 are kinds of characters, the rest are single characters."""
    own = classes().get(c)
    if own is not None:
        return own
    o = ord(c)
    if o < 0x80:
        return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4
    if 0x3040 <= o < 0x30A0:
        return 5
    if 0x30A0 <= o < 0x3100:
        return 6
    if 0x3100 <= o < 0xA000 or o >= 0x20000:
        return 7
    if 0x0370 <= o < 0x0600:
        return 8
    if 0xFF00 <= o < 0xFFF0:
        return 9
    return 10 if unicodedata.category(c)[0] in "LM" else 11


def n_classes() -> int:
    return 12 + len(classes())


class _Classes(dict):
    """The classes of the characters met so far; there are no more than characters."""

    def __missing__(self, c: str) -> int:
        self[c] = class_of(c)
        return self[c]


_class = _Classes()


def encoded(word: str) -> list[int]:
    return [0, *map(_class.__getitem__, word), 0]


class Model:
    """Log emission tables (state, class before, class); state 0 is clean, the last one is lost text.

    Only the bigrams that occur are stored and sent; the tables are made from them where they are used.
    """

    def __init__(self, shape: tuple[int, int, int], places: np.ndarray, weights: np.ndarray, share: float):
        self.shape = shape
        self.places = places.astype(np.int32)
        self.weights = weights.astype(np.float32)
        self.share = share
        self._tables: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"} | {"_tables": None}

    @property
    def priors(self) -> np.ndarray:
        out = np.full(self.shape[0], np.log(self.share), dtype=np.float32)
        out[0] = 0.0
        return out

    @property
    def tables(self) -> np.ndarray:
        if self._tables is None:
            counts = np.zeros(self.shape, dtype=np.float32).reshape(-1)
            counts[self.places] = self.weights
            counts = counts.reshape(self.shape)
            tables = np.empty(self.shape, dtype=np.float32)
            for k, n in enumerate(counts):
                uni = n.sum(axis=0) + 0.05
                uni /= uni.sum()
                tables[k] = np.log((n + 2.0 * uni) / (n.sum(axis=1, keepdims=True) + 2.0))
            # ASCII follows ASCII in the same way whatever the encoding
            tables[1:, :5, :5] = tables[0, :5, :5]
            self._tables = tables
        return self._tables


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigram weights of the words as they are (state 0) and as each pair garbles them."""
    c = n_classes()
    sums: dict[tuple[int, int], float] = {}
    for b in batches:
        # words of one weight are counted together
        for n, same in b.groupby("n")["word"]:
            weight = float(np.log2(1 + n))
            for k, pair in enumerate([None, *PAIRS]):
                counted: Counter = Counter()
                for word in same:
                    w = word if pair is None else garble(word, pair)
                    if w is None or (pair is not None and w == word):
                        continue
                    e = encoded(w)
                    counted.update(zip(e, e[1:], strict=False))
                for (x, y), times in counted.items():
                    key = (k, x * c + y)
                    sums[key] = sums.get(key, 0.0) + weight * times
    if sums:
        yield pd.DataFrame({"state": [k for k, _ in sums], "bigram": [b for _, b in sums], "weight": list(sums.values())})


def fit(words: DataFrame, clean: DataFrame | None = None, share: float = 0.004) -> Model:
    """Emission tables from (word, n). ``clean``: the words that an earlier round left unlabelled. Without it the clean
    state is taken from all words, less what garbling the corpus explains at ``share`` of the words for each pair."""
    c = n_classes()
    source = words if clean is None else clean
    rows = source.mapInPandas(_counts, "state int, bigram int, weight double").groupBy("state", "bigram").agg(F.sum("weight").alias("weight")).toPandas()
    # only the clean state and what garbling explains are needed as whole tables; the others stay sparse
    state = rows["state"].to_numpy(dtype=np.int32)
    bigram = rows["bigram"].to_numpy(dtype=np.int64)
    weight = rows["weight"].to_numpy(dtype=np.float32)
    plain_words = np.zeros(c * c, dtype=np.float32)
    plain_words[bigram[state == 0]] = weight[state == 0]
    everything = float(plain_words.sum()) or 1.0
    if clean is None:
        explained = np.zeros(c * c, dtype=np.float32)
        for k in range(1, len(PAIRS) + 1):
            total = float(weight[state == k].sum())
            if total:
                explained[bigram[state == k]] += weight[state == k] * (3 * share * everything / max(total, everything))
        before, after = np.divmod(np.arange(c * c), c)
        foreign = (before >= 5) | (after >= 5)
        plain_words = np.where(foreign, np.maximum(plain_words - explained, 0.0), plain_words)
    square = plain_words.reshape(c, c)
    for c1 in [LOST, *map(chr, range(0x80, 0xA0))]:  # no clean writer produces these
        square[:, classes()[c1]] = square[classes()[c1], :] = 0
    lost = classes()[LOST]
    lost_square = np.zeros((c, c), dtype=np.float32)
    lost_square[:, lost] = 1.0
    lost_square[lost, :] = 0.05
    states, places, weights = [], [], []
    for k, dense in ((0, square.reshape(-1)), (len(PAIRS) + 1, lost_square.reshape(-1))):
        at = np.flatnonzero(dense)
        states.append(np.full(len(at), k, dtype=np.int64))
        places.append(at)
        weights.append(dense[at])
    garbled = state > 0
    states.append(state[garbled].astype(np.int64))
    places.append(bigram[garbled])
    weights.append(weight[garbled])
    return Model((len(PAIRS) + 2, c, c), np.concatenate(states) * (c * c) + np.concatenate(places), np.concatenate(weights), share)


_models: dict[int, Model] = {}


def _loaded(key: int, blob: bytes) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(blob)
    return _models[key]


def likelihood(model: Model, word: str, state: int = 0) -> float:
    e = encoded(word)
    t = model.tables[state]
    return float(sum(t[x, y] for x, y in zip(e, e[1:], strict=False)))


def _one_script(word: str) -> bool:
    """False if single letters of another script stand among Latin ones (a typing error may do the reverse)."""
    ascii_letters = sum(c.isascii() and c.isalpha() for c in word)
    other = sum(ord(c) >= 0x370 and c.isalpha() for c in word)
    return other == 0 or other >= ascii_letters


def readings(model: Model, word: str, slack: float = 6.0) -> list[tuple[int, str, float]]:
    """(state, inverse image, gain) of each pair that can invert the word to one about as likely in the clean state."""
    out = []
    floor = None
    for k, pair in enumerate(PAIRS, 1):
        v = restore(word, pair)
        if v is None or v == word or LOST in v or any(0x7F <= ord(c) < 0xA0 or ord(c) < 0x20 for c in v):
            continue
        if not _one_script(v):
            continue
        if floor is None:
            floor = likelihood(model, word)
        gain = likelihood(model, v) - floor
        if gain >= -slack:
            out.append((k, v, gain))
    return out


def viterbi(model: Model, words: list[str], bonus: np.ndarray, leave: float = -6.0) -> list[np.ndarray]:
    """The most likely states of each word's characters. ``bonus``: (word, state) evidence from the inverse image."""
    k = len(model.tables)
    enter = model.priors
    longest = max(map(len, words))
    n = len(words)
    code = np.zeros((n, longest + 2), dtype=np.int32)
    for i, w in enumerate(words):
        e = encoded(w)
        code[i, : len(e)] = e
    lengths = np.array([len(w) for w in words])
    score = np.broadcast_to(enter, (n, k)) + bonus
    back = np.zeros((longest + 1, n, k), dtype=np.int8)
    done = np.zeros((n, k), dtype=np.float32)
    states = np.arange(k)
    for t in range(1, longest + 2):
        if t > 1:
            # stay, or go over the clean state
            to_clean = score + leave
            to_clean[:, 0] = score[:, 0]
            best_in = to_clean.argmax(axis=1)
            clean = np.take_along_axis(to_clean, best_in[:, None], 1)[:, 0]
            moved = score[:, :1] + enter[None, :] + leave
            stay = score >= moved
            new = np.where(stay, score, moved)
            frm = np.where(stay, states[None, :], 0)
            new[:, 0] = clean
            frm[:, 0] = best_in
            back[t - 1] = frm
            score = new
        score = score + model.tables[:, code[:, t - 1], code[:, t]].T
        ends = lengths == t - 1
        done[ends] = score[ends]
    out = []
    for i, w in enumerate(words):
        at = int(done[i].argmax())
        path = np.zeros(len(w), dtype=np.int8)
        for t in range(len(w), 0, -1):
            # back[t] is how the state for position t + 1 was reached
            at = int(back[t][i, at]) if t <= longest else at
            path[t - 1] = at
        out.append(path)
    return out


def _decide(model: Model, words: list[str], counts: list[int], readings_of: list[list[tuple[int, str, float, int]]]) -> list[tuple[bool, str, str]]:
    """(garbled, restored text or the word itself, pair) of each word."""
    k = len(model.tables)
    bonus = np.full((len(words), k), -4.0, dtype=np.float32)
    bonus[:, 0] = 0.0
    bonus[:, -1] = 0.0
    for i, (n, rs) in enumerate(zip(counts, readings_of, strict=True)):
        for s, _, gain, known in rs:
            # the better known of the two is likely the original; where neither is known, the likelier
            bonus[i, s] = np.clip(1.5 * np.log((known + 0.3) / (n + 0.3)), -4.0, 9.0) + np.clip(0.3 * gain, -4.0, 6.0)
    out = []
    # long words are labelled in windows, with the evidence of the whole word; the decision is the whole word's
    windows = [(i, at) for i, w in enumerate(words) for at in range(0, max(len(w), 1), WINDOW)]
    piece = lambda k: words[k[0]][k[1] : k[1] + WINDOW]
    windows.sort(key=lambda k: (len(piece(k)), k))
    labelled: dict[tuple[int, int], np.ndarray] = {}
    for lo in range(0, len(windows), 2000):
        part = windows[lo : lo + 2000]
        for k, p in zip(part, viterbi(model, [piece(k) for k in part], bonus[[i for i, _ in part]]), strict=True):
            labelled[k] = p
    placed = {i: np.concatenate([labelled[i, at] for at in range(0, max(len(w), 1), WINDOW)]) for i, w in enumerate(words)}
    for i, w in enumerate(words):
        path = placed[i]
        if LOST in w:
            out.append((True, w, "lost"))
            continue
        labels = [s for s in path if 0 < s <= len(PAIRS)]
        if not labels:
            out.append((False, w, ""))
            continue
        s = max(set(labels), key=labels.count)
        whole = {x: (known, gain, v) for x, v, gain, known in readings_of[i]}
        if whole:  # exact check: of the pairs that invert the whole word, the one whose image is known best
            best = max(whole, key=lambda x: (whole[x][0], x == s, whole[x][1]))
            s = best if whole[best][0] > whole.get(s, (0,))[0] else s
        pair = PAIRS[s - 1]
        restored = whole[s][2] if s in whole else None
        if restored is None:  # span by span
            pieces, at = [], 0
            while at < len(w):
                end = at
                while end < len(w) and path[end] == path[at]:
                    end += 1
                span = w[at:end]
                back = restore(span, PAIRS[path[at] - 1]) if 0 < path[at] <= len(PAIRS) else span
                pieces.append(span if back is None else back)
                at = end
            restored = "".join(pieces)
            if restored == w or any(0x80 <= ord(c) < 0xA0 for c in restored):
                # no inverse: only text that no clean writer produces is garbled for sure
                sure = any(0x80 <= ord(c) < 0xA0 for c in w) or len(labels) >= 3
                out.append((sure, w, ">".join(map(str, pair)) if sure else ""))
                continue
        out.append((True, restored, ">".join(map(str, pair))))
    return out


def garbled_words(words: DataFrame, rounds: int = 2) -> DataFrame:
    """(word, n, restored, pair) of the garbled among distinct words (word, n) that aren't plain ASCII.

    Each round labels all words; the next one learns its clean state from those left unlabelled.
    """
    words = written(words.repartition(2 * words.sparkSession.sparkContext.defaultParallelism, "word"))
    # case and surrounding punctuation don't matter for how well a word is known
    known = written(words.groupBy(_bare("word").alias("bare")).agg(F.sum("n").alias("known")))
    found, clean = None, None
    for _ in range(rounds):
        found = written(_labelled(words, known, fit(words, clean)))
        clean = words.join(found.select("word"), "word", "left_anti")
    return found


def _bare(c: str) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\x00-\x7F&&[^A-Za-z0-9]]+|[\x00-\x7F&&[^A-Za-z0-9]]+$", ""))


def _labelled(words: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    blob = pickle.dumps(model)
    sc = words.sparkSession.sparkContext
    key = hash(blob)
    sent = sc.broadcast(blob)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(key, sent.value)
        for b in batches:
            rows = [(w, int(n), s, v, g) for w, n in zip(b["word"], b["n"], strict=True) for s, v, g in (readings(model, w) or [(0, "", 0.0)])]
            yield pd.DataFrame(rows, columns=["word", "n", "state", "image", "gain"])

    images = words.mapInPandas(read, "word string, n bigint, state int, image string, gain double")
    own = known.select(F.col("bare").alias("own_bare"), F.col("known").alias("own"))
    weighed = (
        images.withColumn("bare", _bare("image")).withColumn("own_bare", _bare("word")).join(known, "bare", "left").join(own, "own_bare", "left")
        .groupBy("word").agg(F.first("n").alias("n"), F.max("own").alias("own"), F.collect_list(F.struct("state", "image", "gain", F.coalesce("known", F.lit(0)).alias("known"))).alias("images"))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(key, sent.value)
        for b in batches:
            ws, ns, own = list(b["word"]), [int(x) for x in b["n"]], [int(x) for x in b["own"]]
            rs = [[(r["state"], r["image"], r["gain"], r["known"]) for r in x if r["state"]] for x in b["images"]]
            got = _decide(model, ws, own, rs)
            out = [(ws[i], ns[i], g[1], g[2]) for i, g in enumerate(got) if g[0]]
            yield pd.DataFrame(out, columns=["word", "n", "restored", "pair"])

    return weighed.mapInPandas(decide, "word string, n bigint, restored string, pair string")


def garbled_texts(cells: DataFrame) -> DataFrame:
    """(cell, n_rows, restored, pairs) of the garbled among distinct texts (cell, n_rows)."""
    cells = written(cells.filter(F.col("cell").rlike(r"[^\x00-\x7F]")))
    # words and the single characters between them
    pieces = F.split("cell", r"(?<=[ _])|(?=[ _])", -1)
    parts = cells.select("cell", "n_rows", F.posexplode(pieces).alias("pos", "word"))
    foreign = parts.filter(F.col("word").rlike(r"[^\x00-\x7F]"))
    words = foreign.groupBy("word").agg(F.sum("n_rows").alias("n"))
    bad = written(garbled_words(words).withColumn("n_rows", F.col("n")))
    hit = join_counted(foreign.select("cell", "pos", "word"), bad.select("word", "restored", "pair", "n_rows"), ["word"])
    mended = hit.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("pos", "restored"))).alias("by_pos"), F.array_join(F.sort_array(F.collect_set("pair")), ",").alias("pairs"))
    texts = F.array_join(F.transform(pieces, lambda w, i: F.coalesce(F.try_element_at("by_pos", i), w)), "")
    return cells.join(mended, "cell").select("cell", "n_rows", texts.alias("restored"), "pairs")


def garbled_cells(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(``id_col``, field, cell, restored, pairs) of every cell of which some part was decoded wrongly.

    ``restored`` has the original where it can be recovered (lost characters stay U+FFFD), ``pairs`` how it was garbled.
    Null, empty and plain ASCII cells are never garbled; a repeated row counts once; null ids give no row.
    """
    long = rows.filter(F.col(id_col).isNotNull()).select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])).alias("s")).select(id_col, "s.*").filter(F.col("cell").rlike(r"[^\x00-\x7F]")).distinct()
    done = written(garbled_texts(long.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))))
    return join_counted(long, done, ["cell"]).select(id_col, "field", "cell", "restored", "pairs")
