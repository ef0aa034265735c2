"""Garbled text from wrong character encoding: find it, name the encoding chain, restore the text.

A multinomial (softmax) classifier on hashed bigrams of UTF-8 bytes tells, for each sentence, line or part of a long one,
the chain "bytes of encoding A read as encoding B" that garbled it, or *clean*. It is trained here, on a bounded sample of
the corpus' own sentences (``SAMPLE`` per language label) and copies of them garbled by each chain, some in capitals and
some with the bytes dropped that have no character. The predicted chain is inverted: the text must encode strictly in B and
those bytes decode strictly in A, and the classifier must find the outcome cleaner.

* UTF-8 read as a single-byte encoding leaves runs that decode strictly, which hardly any intended text does; such runs are
  undone wherever they stand, layer by layer, unless a single one stands in a text that the classifier is sure of.
* A single-byte encoding read as another decodes strictly whatever the text is; there the outcome must also consist of words
  that are no rarer in the whole corpus than those it replaces. Words are counted over distinct texts, without the text in
  question; only the words that some text asks about are counted.
* U+FFFD and C1 controls are traces of a decoding that lost bytes: such text is reported, and restored where it can be.
* A text that the classifier is sure is garbled is reported even where no inversion is accepted.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Scratch

SAMPLE = 300  # clean sentences per language label for training, at most
LABELS = 40  # language labels, at most
COPIES = 8  # garbled copies per sampled sentence, at most
WIDTH = 4096
EPOCHS = 4
PIECE = 200  # characters that are judged at once; longer sentences are cut at blanks
PASS = 0.5  # taken as clean from this probability on, unless strict runs or traces say otherwise
SURE = 0.002  # a text that is less probably clean is reported, restored or not
TRIES = 4  # most probable chains that are inverted
SENTENCE = re.compile(r"((?<=[.!?]) +|(?<=[。！？])|[\n\r]+)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_BLANKS = r"[ \t\n\r]+"
_WIDE = re.compile("[\u2e80-\U0010ffff]")  # scripts that put no blanks between words
REPLACED = "\ufffd"

# Which encoding was read as which.
_READ_AS = {
    "utf-8": ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gbk", "cp932", "koi8_r", "cp866", "cp1253", "cp1254"],
    "cp1252": ["mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8_r", "cp866"],
    "mac_roman": ["latin-1", "cp1252"],
    "cp437": ["latin-1", "cp1252"],
    "cp850": ["latin-1", "cp1252"],
    "cp1250": ["latin-1", "cp1252"],
    "iso8859_2": ["latin-1", "cp1252"],
    "cp852": ["latin-1", "cp1252"],
    "cp1254": ["latin-1", "cp1252"],
    "cp857": ["latin-1", "cp1252"],
    "cp1253": ["latin-1", "cp1252"],
    "iso8859_7": ["latin-1", "cp1252"],
    "cp737": ["latin-1", "cp1252"],
    "cp1251": ["latin-1", "cp1252", "koi8_r", "mac_roman", "cp866"],
    "koi8_r": ["latin-1", "cp1252", "cp1251"],
    "cp866": ["latin-1", "cp1252", "cp1251"],
    "iso8859_5": ["latin-1", "cp1252"],
    "gbk": ["latin-1", "cp1252"],
    "big5": ["latin-1", "cp1252"],
    "cp932": ["latin-1", "cp1252", "gbk"],
    "euc_jp": ["latin-1", "cp1252", "gbk"],
}
CHAINS: list[tuple[tuple[str, str], ...]] = [((a, b),) for a, bs in _READ_AS.items() for b in bs]
CHAINS += [(("utf-8", b), ("utf-8", c)) for b in ("latin-1", "cp1252") for c in ("latin-1", "cp1252")]
CLEAN = len(CHAINS)


def chain_name(chain: int) -> str:
    return "clean" if chain == CLEAN else " > ".join(f"{a} as {b}" for a, b in CHAINS[chain])


@cache
def _table(codec: str) -> tuple[str, dict[str, int]] | None:
    """256 characters of a single-byte encoding; a byte without a character keeps its number, as lenient decoders do."""
    if codec in ("utf-8", "gbk", "cp932", "big5", "euc_jp"):
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed([*enumerate(chars)])}


def _encode(text: str, codec: str) -> bytes:
    table = _table(codec)
    if table is None:
        return text.encode(codec)
    try:
        return bytes([table[1][c] for c in text])
    except KeyError:
        raise UnicodeError(codec) from None


def _decode(raw: bytes, codec: str, errors: str = "strict") -> str:
    table = _table(codec)
    return raw.decode(codec, errors) if table is None else "".join([table[0][b] for b in raw])


def garble(text: str, chain: int) -> str | None:
    """The text as the chain leaves it; null where an encoding lacks a character or nothing changes."""
    out = text
    try:
        for a, b in CHAINS[chain]:
            out = _decode(out.encode(a), b, "replace")
    except UnicodeError:
        return None
    return out if out != text else None


def invert(text: str, chain: int) -> str | None:
    """Undoes the chain if every step encodes and decodes strictly."""
    out = text
    try:
        for a, b in reversed(CHAINS[chain]):
            out = _decode(_encode(out, b), a)
    except UnicodeError:
        return None
    return out if out != text else None


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of all texts at once: log counts of the hashed byte bigrams that touch a byte beyond ASCII, of
    unit length per text."""
    raw = np.frombuffer("\n".join([f" {t} ".replace("\n", " ") for t in texts]).encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)
    row = np.cumsum(raw == 10)
    at = np.flatnonzero((raw[:-1] > 127) | (raw[1:] > 127))
    bucket = (((raw[at] * 256 + raw[at + 1]) * 40503) >> 4) % WIDTH
    key, count = np.unique(row[at] * WIDTH + bucket, return_counts=True)
    row, value = key // WIDTH, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(texts)))
    return row, key % WIDTH, (value / norm[row]).astype(np.float32)


def _softmax(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


@dataclass
class Detector:
    """weights (bigram bucket x chain) and intercepts of the classifier, and the characters of the sampled clean text."""

    weights: np.ndarray
    intercept: np.ndarray
    alphabet: frozenset = frozenset()
    blocks: frozenset = frozenset()

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, CLEAN + 1))]
        for i in range(0, len(texts), 1024):
            part = texts[i : i + 1024]
            score = np.tile(self.intercept, (len(part), 1))
            row, bucket, value = _features(part)
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                score[row[first]] += np.add.reduceat(self.weights[bucket] * value[:, None], first, axis=0)
            out.append(_softmax(score))
        return np.concatenate(out)

    def plausible(self, char: str) -> bool:
        """A character of the corpus' clean text, or a letter from a stretch of the code table that this text uses."""
        return char in self.alphabet or (char.isalpha() and _block(char) in self.blocks) or ord(char) > 0xFFFF


def _block(char: str) -> int:
    """A stretch of the code table: 128 characters of an alphabet, 4,096 of other scripts, all ideographs and kana as one."""
    return -1 if "\u2e80" <= char < "\ua000" else ord(char) >> (12 if char >= "\ua000" else 7)


def _traces(text: str) -> bool:
    """Characters that only a wrong decoding leaves: the replacement character and C1 controls."""
    return REPLACED in text or re.search("[\x80-\x9f]", text) is not None


# UTF-8 read as a single-byte encoding: runs of its characters that are whole UTF-8 sequences.


@cache
def _sequences(codec: str) -> tuple[re.Pattern, re.Pattern]:
    """(runs of sequences, one sequence) in the characters of a single-byte encoding."""
    chars = _table(codec)[0]
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c in chars[lo : hi + 1]) + "]"
    more = of(0x80, 0xBF)
    one = f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})"
    return re.compile(f"{one}+"), re.compile(one)


UTF8_AS = [b for b in _READ_AS["utf-8"] if _table(b) is not None and b != "cp866"]  # in cp866 plain Russian letters form sequences


def undo_utf8(text: str, codec: str, detector: Detector) -> tuple[str, int, int]:
    """The text with every plausible run of UTF-8 sequences decoded, the number of sequences and of their characters."""
    done = used = 0
    again = _table("cp1252")[1]  # characters of a further layer

    def decode(m: re.Match) -> str:
        nonlocal done, used
        try:
            out = _encode(m[0], codec).decode("utf-8")
        except UnicodeError:
            return m[0]
        if not all(detector.plausible(c) or c in again for c in out):
            return m[0]
        done, used = done + len(out), used + len(m[0])
        return out

    return _sequences(codec)[0].sub(decode, text), done, used


@cache
def _any_sequence() -> re.Pattern:
    return re.compile("|".join(_sequences(b)[1].pattern for b in UTF8_AS))


def suspicious(text: str) -> bool:
    """Never a clean training sentence: traces or strict sequences that clean text does not have."""
    return _traces(text) or any(len(m[0]) > 2 or _table("cp1252")[1].get(m[0][0], 0) in (0xC2, 0xC3) for m in _any_sequence().finditer(text))


def train(clean: list[str], seed: int = 5) -> Detector:
    """The classifier of a sample of sentences, repeatable for the same sentences. Sentences that a classifier of the other
    half of the sample takes for garbled are left out first, so that garbled text in the sample does not pass as clean."""
    clean = [t for t in sorted(set(clean)) if not t.isascii() and not suspicious(t)]
    halves = [clean[0::2], clean[1::2]]
    judged = [_fit(halves[1 - i], seed, 2).probabilities(h)[:, CLEAN] for i, h in enumerate(halves)]
    return _fit([t for h, p in zip(halves, judged) for t, q in zip(h, p) if q >= 0.05], seed, EPOCHS)


def _fit(clean: list[str], seed: int, epochs: int) -> Detector:
    """Softmax regression by Adam over clean sentences and garbled copies."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for t in clean:
        made = [(g, k) for base in (t, t.upper()) for k in range(CLEAN) if (g := garble(base, k)) is not None]
        half = len(made) // 2
        chance = np.r_[np.full(half, 3.0), np.full(len(made) - half, 1.0)]  # capitals are the rarer case
        for i in rng.choice(len(made), min(COPIES, len(made)), replace=False, p=chance / chance.sum()) if made else []:
            g, k = made[i]
            if CHAINS[k][0][0] == "utf-8" and rng.random() < 0.35:
                g = re.sub("[\x80-\xa0\xad]", "", g)  # bytes without a visible character are often lost
            texts.append(g)
            labels.append(k)
        texts += [t, t, t.upper()]
        labels += [CLEAN] * 3
    w, b = np.zeros((WIDTH, CLEAN + 1), dtype=np.float32), np.zeros(CLEAN + 1, dtype=np.float32)
    b[CLEAN] = 2.0
    letters = Counter(c for t in clean for c in set(t) if ord(c) > 127)
    alphabet = frozenset(c for c, n in letters.items() if n > 1)
    detector = Detector(w, b, alphabet, frozenset(_block(c) for c in alphabet if ord(c) > 255))
    if not texts:
        return detector
    row, bucket, value = _features(texts)
    start = np.searchsorted(row, np.arange(len(texts) + 1))
    m, v, step, y = np.zeros_like(w), np.zeros_like(w), 0, np.array(labels)
    for _ in range(max(epochs, -(-30_000 // len(texts)))):  # 60 steps at least
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            size = start[part + 1] - start[part]
            where = np.repeat(start[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            x = np.zeros((len(part), WIDTH), dtype=np.float32)
            x[np.repeat(np.arange(len(part)), size), bucket[where]] = value[where]
            p = _softmax(x @ w + b)
            p[np.arange(len(part)), y[part]] -= 1
            g = x.T @ p / len(part)
            step += 1
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            w -= 0.05 / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
            b -= 0.5 * p.mean(0)
    return detector


def training_sentences(docs: DataFrame, text: str, label: str, per_label: int = SAMPLE, labels: int = LABELS) -> list[str]:
    """A bounded, repeatable sample: by hash, up to ``per_label`` non-ASCII sentences of each label (its first two letters),
    labels in the order of their names where there are more than ``labels``."""
    tag = F.substring(F.lower(F.coalesce(F.trim(label), F.lit("?"))), 1, 2)
    parts = docs.select(tag.alias("tag"), F.explode(F.split(F.col(text), r"(?<=[.!?。！？])\s*|[\n\r]+")).alias("s"))
    parts = parts.filter(F.col("s").rlike(r"[^\x00-\x7f]") & (F.length("s") <= 400) & (F.length("s") >= 4)).withColumn("h", F.xxhash64("s"))
    place = Window.partitionBy("tag").orderBy("h", "s")
    rows = parts.withColumn("r", F.dense_rank().over(place)).filter(F.col("r") <= per_label).select("r", "tag", "s").distinct()
    return [r.s for r in rows.orderBy("r", "tag").limit(per_label * labels).select("s").collect()]


def _words(text: str) -> Counter:
    """The words with non-ASCII characters of a text in a script with blanks."""
    return Counter(w for x in re.split(_BLANKS, text) if not (w := x.strip(_EDGES)).isascii() and not _WIDE.search(w))


def words_of(text: str) -> list[str]:
    return sorted(_words(text))


def word_column(text: Column) -> Column:
    """``words_of`` as an expression."""
    odd = F.filter(F.split(text, _BLANKS), lambda x: x.rlike(r"[^\x00-\x7f]") & ~x.rlike("[\u2e80-\uffff]") & ~x.rlike(r"[\x{10000}-\x{10ffff}]"))
    return F.array_distinct(F.transform(odd, lambda x: F.trim(x, F.lit(_EDGES))))


def no_rarer(fixed: str, text: str, counts: dict[str, int]) -> bool:
    """Whether the words that a restoration brings in are at least as common elsewhere in the corpus as those it replaces.

    ``counts``: distinct texts with the word; the text itself is one of those of a replaced word.
    """
    new, old = _words(fixed), _words(text)
    brought = sum(n * np.log1p(counts.get(w, 0)) for w, n in (new - old).items())
    return brought >= sum(n * np.log1p(max(0, counts.get(w, 0) - 1)) for w, n in (old - new).items())


def _needs_words(chain: int) -> bool:
    return all(_table(a) is not None for a, _ in CHAINS[chain])


def _by_runs(text: str, chain: int) -> str | None:
    """Undoes a chain over the whole text, or else in every run of non-ASCII characters that decodes strictly."""
    core = text.rstrip("。！？")  # sentence marks that follow a garbled part
    if (whole := invert(core, chain)) is not None:
        return whole + text[len(core) :]
    if CHAINS[chain][0][0] != "utf-8":
        return None
    out = re.sub(r"[^\x00-\x7f]+", lambda m: invert(m[0], chain) or m[0], text)
    return out if out != text else None


def _wide_share(text: str, detector: Detector) -> float:
    """Share of plausible characters among those of scripts without blanks."""
    wide = _WIDE.findall(text)
    return sum(c in detector.alphabet for c in wide) / len(wide) if wide else 0.0


def _strict_runs(text: str, p: np.ndarray, detector: Detector) -> tuple[str, list[int], int]:
    """(text, chains, sequences) with all layers of UTF-8 read as single-byte encodings undone."""
    chains, total = [], 0
    while len(chains) < 3 and _any_sequence().search(text):
        tries = [(*undo_utf8(text, b, detector), b) for b in UTF8_AS]
        best = max(tries, key=lambda t: (t[2], p[CHAINS.index((("utf-8", t[3]),))]))
        if not best[1]:
            break
        text, total = best[0], total + best[1]
        chains.append(CHAINS.index((("utf-8", best[3]),)))
    return text, chains, total


def restore_sentence(text: str, p: np.ndarray, detector: Detector, counts: dict[str, int] | None) -> tuple[str | None, int, bool, set[str]]:
    """(restored or null, chain, garbled, words asked for) of one text with class probabilities ``p``.

    With ``counts`` null a restoration that depends on word counts only asks for them.
    """
    clean, traces, asked = float(p[CLEAN]), _traces(text), set()
    fixed, chains, n = _strict_runs(text, p, detector)
    runs = bool(chains) and (traces or clean < 0.9 or n > 1 and clean < 0.998)
    of_utf8 = sum(float(p[k]) for k in range(CLEAN) if CHAINS[k][0][0] == "utf-8")
    if runs and of_utf8 >= 0.3 * (1 - clean):
        return fixed, chains[0], True, asked
    if clean >= PASS and not traces and not runs:
        return None, CLEAN, False, asked
    order = [int(k) for k in np.argsort(-p)[: TRIES + 1] if k != CLEAN][:TRIES]
    tries = [(k, out) for k in order if (p[k] > 0.01 or p[k] > clean) and (out := _by_runs(text, k)) is not None]
    if tries:
        after = detector.probabilities([out for _, out in tries])[:, CLEAN]
        for i in sorted(range(len(tries)), key=lambda i: -(after[i] + p[tries[i][0]])):
            k, out = tries[i]
            if out.isascii() or after[i] < max(0.5, clean + 0.2):
                continue
            source = CHAINS[k][0][0]
            if _needs_words(k):
                asked |= {*_words(out), *_words(text)}
                if counts is None or not no_rarer(out, text, counts):
                    continue
            elif source != "utf-8" and (_wide_share(out, detector) < 0.7 or p[k] < clean):
                continue
            return out, k, True, asked
    if runs and not asked:
        return fixed, chains[0], True, asked
    lost = clean < SURE or (clean < 0.05 and of_utf8 > 0.9)  # bytes without a character were dropped
    return None, order[0], lost or traces, asked


def pieces(text: str) -> list[str]:
    """Sentences, lines and the marks between them; long ones are cut at blanks. Joined they give the text."""
    out = []
    for s in SENTENCE.split(text):
        while len(s) > PIECE and not s.isascii():
            at = s.find(" ", PIECE // 2, PIECE) + 1 or PIECE
            out.append(s[:at])
            s = s[at:]
        out.append(s)
    return out


Found = tuple[bool, str | None, str | None, bool, list[str] | None]


def restore(texts: list[str | None], detector: Detector, counts: list[dict[str, int] | None]) -> list[Found]:
    """(garbled, chains, restored text, complete, words asked for) of each text with the counts of its words, if they are
    known; complete: nothing garbled is left."""
    split = [pieces(t) if t and not t.isascii() else [] for t in texts]
    todo = sorted({s for parts in split for s in parts if not s.isascii()})
    likely = dict(zip(todo, detector.probabilities(todo)))
    out: list[Found] = []
    for t, parts, words in zip(texts, split, counts):
        known = {s: restore_sentence(s, likely[s], detector, words) for s in set(parts) if s in likely}
        asked = sorted(set().union(*(k[3] for k in known.values()))) if words is None else []
        hits = [known[s] for s in parts if s in known and known[s][2]]
        if not hits:
            out.append((False, None, None, True, asked or None))
            continue
        fixed = "".join(known[s][0] if s in known and known[s][2] and known[s][0] is not None else s for s in parts)
        chains = ", ".join(sorted({chain_name(k) for _, k, _, _ in hits}))
        out.append((True, chains, fixed if fixed != t else None, all(f is not None and not _traces(f) for f, _, _, _ in hits), asked or None))
    return out


def find_garbled(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, chains, restored, complete): one row per document with garbled characters.

    ``restored`` is the text with every restorable sentence restored, null where none is; ``complete`` tells whether all
    garbled sentences were restored. Null, empty and pure ASCII texts are never garbled; rows without a key are left out.
    Other columns are ignored. Repeated rows come out as often as they stand in the input.

    One pass over the texts decides all but the few that depend on word counts; copies cost map work only. The words those
    few ask about are then counted over all distinct texts (by hash, narrow rows), and only those few are judged again.
    """
    scratch = Scratch(docs.sparkSession)
    detector = train(training_sentences(docs, text, label))
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter(F.col(text).rlike(r"[^\x00-\x7f]") & F.col(key).isNotNull())
    schema = f"__key {kind}, garbled boolean, chains string, restored string, complete boolean"

    def rows(pdf, found, keep, **more):
        picked = [found[i] for i in keep]
        columns = {n: [f[i] for f in picked] for i, n in enumerate(("garbled", "chains", "restored", "complete"))}
        return pd.DataFrame({"__key": pdf["__key"].iloc[keep].to_numpy(), **{n: pd.Series(c, dtype=object) for n, c in (columns | more).items()}})

    def judge(batches):
        for pdf in batches:
            found = restore(pdf["__text"].tolist(), detector, [None] * len(pdf))
            keep = [i for i, f in enumerate(found) if f[0] or f[4]]
            yield rows(pdf, found, keep, __text=[pdf["__text"].iloc[i] if found[i][4] else None for i in keep], words=[found[i][4] for i in keep])

    def judge_again(batches):
        for pdf in batches:
            found = restore(pdf["__text"].tolist(), detector, [dict(c) if c is not None else {} for c in pdf["counts"]])
            yield rows(pdf, found, [i for i, f in enumerate(found) if f[0]])

    first = scratch.put(narrow.mapInPandas(judge, f"{schema}, __text string, words array<string>"))
    doubtful = first.filter("words is not null").withColumn("id", F.xxhash64("__text"))
    wanted = scratch.put(doubtful.select("id", F.explode("words").alias("w")).distinct())
    uses = narrow.select(F.explode(word_column(F.col("__text"))).alias("w"), F.xxhash64("__text").alias("of"))
    counts = uses.join(wanted.select("w").distinct(), "w", "left_semi").distinct().groupBy("w").agg(F.count("*").alias("n"))
    held = wanted.join(counts, "w").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("counts"))
    again = doubtful.select("__key", "__text", "id").join(held, "id", "left").mapInPandas(judge_again, schema)
    found = scratch.put(again).union(first.filter("words is null").select(*again.columns))
    return found.select(F.col("__key").alias(key), "chains", "restored", "complete")
