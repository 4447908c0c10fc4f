"""Garbled text from a wrong character encoding.

A multinomial classifier over hashed byte bigrams is trained on clean sentences of the corpus and on the same sentences
garbled through every encoding chain below. It names the most likely chain of each suspicious stretch, among those by which
the stretch decodes strictly into characters in use; that chain is inverted. Chains whose inverse nearly always decodes
(one encoding read as another) are named by the classifier over whole sentences, and the restored sentence must be far more
like intact text and consist of words in use; what words and characters are in use is counted over all documents. What
decoders leave of bytes that they can't read, U+FFFD and control characters, can only be reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import column

# fixed values: encodings that UTF-8 text is read as by mistake, and pairs of other encodings taken for each other
SINGLE = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")
MULTI = ("cp932",)
SWAPPED = (("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp932", "cp1252"), ("euc_jp", "cp1252"), ("cp932", "latin_1"), ("euc_jp", "latin_1"))
MULTI_SOURCE = ("cp932", "euc_jp")
BUCKETS = 1 << 15
WORD_BUCKETS = 1 << 21
#: What a decoder leaves of bytes that it can't read: the replacement character, or control characters of no text.
LOST = regex.compile("[\ufffd\x80-\x84\x86-\x9f]+")
RUN = regex.compile(r"[^\x00-\x7f]+")
SENTENCE = regex.compile(r"[^\n.!?。]+[\n.!?。]*|[\n.!?。]+")
#: Something garbled that the text puts between quotation marks, without any letter of its own: an example.
QUOTED = regex.compile(r"[\"'«‹„“”‚‘’「『(\[`]\s?([^\x00-\x7f\s«»‹›„“”‘’「」『』]{1,8})\s?[\"'»›“”‘’」』)\]`]")
#: Well-formed UTF-8 of more than one byte; 0xff stands for a character that the codec lacks.
WORD = regex.compile(r"[\p{L}\p{M}]+(?:[’'][\p{L}\p{M}]+)*")
UTF8 = regex.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")


@lru_cache(None)
def _decoder(name: str) -> list[str]:
    """Character of each byte; a byte the codec leaves open stands for the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(None)
def _encoder(name: str) -> dict[str, int]:
    table = {c: b for b, c in reversed(list(enumerate(_decoder(name))))}
    # C1 controls stand for their own bytes in text that was read as latin-1
    return {chr(b): b for b in range(0x80, 0xA0)} | table


def garble(text: str, chain: str) -> str | None:
    """The text read through a chain's wrong encoding; None where the first encoding can't write it."""
    how, _, rest = chain.partition(":")
    a, _, b = rest.partition(">")
    try:
        if how == "twice":
            once = garble(text, f"utf8:utf_8>{b}")
            return garble(once, f"utf8:utf_8>{b}")
        raw = text.encode(a)
    except UnicodeEncodeError:
        return None
    return raw.decode(b, "replace") if b in MULTI else raw.decode("latin_1").translate(_decoder(b))


# fixed values: signs that writers and editors put in place of plain ones
TYPOGRAPHIC = set("—–…“”‘’„•€«»°\u00a0")
CP1252 = {c for c in _decoder("cp1252") if ord(c) > 0x9F}
CHAINS = [*(f"utf8:utf_8>{b}" for b in SINGLE + MULTI), "twice:utf_8>cp1252", *(f"swap:{a}>{b}" for a, b in SWAPPED)]
STRONG = [c for c in CHAINS if not c.startswith("swap:")]


def bigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashed bucket) of the byte bigrams of which one byte at least isn't ASCII."""
    at = np.flatnonzero((raw[:-1] | raw[1:]) & 0x80)
    pair = raw[at].astype(np.uint32) << np.uint32(8) | raw[at + 1]
    return at, (pair * np.uint32(2654435761)) >> np.uint32(32 - 15)


@dataclass
class Classifier:
    """Log probabilities of buckets by class; class 0 is intact text. known: characters in use; counts: words by hash, how
    often they occur."""

    logp: np.ndarray
    known: set[str] = field(default_factory=set)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(WORD_BUCKETS, np.int32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of class scores for each text; all texts' bigrams are looked up at once."""
        out = np.zeros((len(texts), len(self.logp)), np.float32)
        by_bucket = np.ascontiguousarray(self.logp.T)
        for s in range(0, len(texts), 512):
            raw = [t.encode("utf-8", "surrogatepass") + b"\0" for t in texts[s : s + 512]]
            every = np.frombuffer(b"".join(raw), np.uint8)
            at, h = bigrams(every)
            inside = (every[at] != 0) & (every[at + 1] != 0)  # not across two texts
            at, h = at[inside], h[inside]
            of = np.searchsorted(np.cumsum([len(r) for r in raw]), at, "right")
            for u in range(0, len(h), 1 << 16):
                part = by_bucket[h[u : u + (1 << 16)]]
                rows, first = np.unique(of[u : u + (1 << 16)], return_index=True)
                if len(rows):
                    out[s + rows] += np.add.reduceat(part, first, axis=0)
        return out

    def seen(self, word: str) -> int:
        return int(self.counts[word_bucket(word)])


def word_bucket(word: str) -> int:
    """As Spark's xxhash64 of the lower-case word, modulo the buckets."""
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 42) % WORD_BUCKETS


def train(sentences: list[str], known_least: int = 3, smooth: float = 0.1, statistics: tuple[set[str], np.ndarray] | None = None) -> Classifier:
    """Multinomial naive Bayes; sentences that the first model finds garbled are left out of a second training.

    statistics: characters in use and word counts of the whole collection, else those of the sentences.
    """

    def counts(texts: list[str]) -> np.ndarray:
        raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass") + b"\n\n", np.uint8)
        return np.bincount(bigrams(raw)[1], minlength=BUCKETS).astype(np.float64)

    clean = [s for s in sentences if "\ufffd" not in s]
    read_as = [[g if g != s else None for s in clean for g in [garble(s, c)]] for c in CHAINS]

    def fit(kept: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(kept).tolist()
        rows = [counts([clean[i] for i in at])]
        rows += [counts([g for i in at if (g := garbled[i]) is not None]) for garbled in read_as]
        m = np.array(rows) + smooth
        # a chain never met in training must not win by its even spread
        return np.log(m / m.sum(1, keepdims=True)).astype(np.float32)

    first = Classifier(fit(np.ones(len(clean), bool)))
    kept = first.scores(clean).argmax(1) == 0
    intact, logp = [s for s, k in zip(clean, kept, strict=True) if k], fit(kept)
    if statistics is not None:
        return Classifier(logp, *statistics)
    seen = Counter(ch for s in intact for ch in set(s) if ord(ch) > 127)
    in_use = np.bincount([word_bucket(w) for s in intact for w in set(WORD.findall(s))], minlength=WORD_BUCKETS).astype(np.int32)
    return Classifier(logp, {c for c, n in seen.items() if n >= known_least}, in_use)


@lru_cache(None)
def _segments(codec: str) -> regex.Pattern:
    """Stretches of characters other than ASCII that the single-byte codec can have read bytes as."""
    chars = sorted(c for c in _encoder(codec) if ord(c) > 127)
    return regex.compile("[" + "".join(map(regex.escape, chars)) + "]{2,}")


def _inverted(run: str, codec: str) -> list[tuple[int, int, str]]:
    """(start, end, restored text) of the stretches of a run that decode strictly: the bytes in which the codec would have
    read them are UTF-8 without an error."""
    out = []
    if codec in MULTI:
        raw, ends = bytearray(), []
        for ch in run:
            try:
                raw += ch.encode(codec)
            except UnicodeEncodeError:
                raw += b"\xff"
            ends.append(len(raw))
        at = np.array([0, *ends])
        for p in UTF8.finditer(bytes(raw)):
            i, j = np.searchsorted(at, p.start(), "right") - 1, np.searchsorted(at, p.end())
            if p.end() - p.start() >= 0.6 * (at[j] - at[i]):
                # a character that holds bytes of both sides of the stretch can't be had
                out.append((int(i), int(j), bytes(raw[at[i] : at[j]]).decode("utf-8", "replace")))
        return out
    enc = _encoder(codec)
    for m in _segments(codec).finditer(run):
        found = list(UTF8.finditer(bytes(enc[c] for c in m[0])))
        # letters that the codec has anyway may fit here and there by chance
        for p in found if sum(p.end() - p.start() for p in found) >= 0.6 * len(m[0]) else ():
            out.append((m.start() + p.start(), m.start() + p.end(), p[0].decode("utf-8")))
    return out


@lru_cache(None)
def _swap_table(chain: str) -> dict[int, str] | None:
    """What each character of the wrong reading was, where both encodings have a byte a character; else None."""
    a, _, b = chain.partition(":")[2].partition(">")
    if a in MULTI_SOURCE:
        return None
    right = _decoder(a)
    return {ord(c): right[byte] for c, byte in _encoder(b).items() if byte > 127}


class Detector:
    def __init__(self, model: Classifier, margin: float = 2.0, swap_margin: float = 5.0, alone: float = 14.0, in_use: int = 2):
        self.m, self.margin, self.swap_margin, self.alone, self.in_use = model, margin, swap_margin, alone, in_use
        self.swaps = np.array([i + 1 for i, c in enumerate(CHAINS) if c.startswith("swap:")])
        self.feasible = lru_cache(200_000)(self._feasible)

    def _plausible(self, run: str, text: str) -> bool:
        """Whether the restored characters are such as the corpus uses."""
        new = [ch for ch in text if ord(ch) > 127 and ch != "\ufffd"]
        # three or four bytes that fit are evidence enough; two must give a character in use
        sure = any("\x80" <= ch <= "\x9f" and ch != "\x85" for ch in run)
        good = sum((sure and (ord(ch) < 0x180 or 0x370 <= ord(ch) < 0x530)) or ch in self.m.known or 0xA0 <= ord(ch) < 256 or ch in CP1252 or (ord(ch) >= 0x800 and category(ch) not in ("Cn", "Co", "Cs")) for ch in new)
        return bool(new) and good >= 0.9 * len(new)

    def _feasible(self, run: str) -> tuple[tuple[int, tuple[tuple[int, int, str], ...]], ...]:
        """(class, stretches) of the chains by which some of the run decodes strictly into characters in use."""
        out = []
        for i, c in enumerate(CHAINS):
            if c.startswith("utf8:"):
                got = tuple(x for x in _inverted(run, c.partition(">")[2]) if self._plausible(run[x[0] : x[1]], x[2]))
                if got:
                    out.append((i + 1, got))
        return tuple(out)

    def restore(self, text: str) -> tuple[str, list[str], list[str]]:
        """(text as far as it can be had, chains inverted, evidence that can't be inverted)."""
        return self.process([text])[0]

    def process(self, texts: list[str]) -> list[tuple[str, list[str], list[str]]]:
        """restore for many texts: the classifier is asked once a round for all of them."""
        now, chains, lost = list(texts), [[] for _ in texts], [[] for _ in texts]
        todo = [i for i, t in enumerate(texts) if not t.isascii()]
        every = todo
        for _ in range(4):  # text garbled twice is undone twice
            todo = self._undo_runs(now, chains, todo)
            if not todo:
                break
        self._undo_swaps(now, chains, every)
        for i in every:
            quoted = [q.span(1) for q in QUOTED.finditer(now[i])] if LOST.search(now[i]) else []
            if any(not any(a <= m.start() < b for a, b in quoted) for m in LOST.finditer(now[i])):
                lost[i].append("lost")
        return list(zip(now, chains, lost, strict=True))

    def _undo_runs(self, now: list[str], chains: list[list[str]], todo: list[int]) -> list[int]:
        """Undo the runs of UTF-8 read as something else; the texts that changed."""
        asked: list[tuple[int, int, int, tuple]] = []
        context: list[str] = []
        for i in todo:
            text, inside = now[i], None
            for m in RUN.finditer(text):
                options = self.feasible(m[0])
                if not options:
                    continue
                inside = [q.span(1) for q in QUOTED.finditer(text)] if inside is None else inside
                if any(a <= m.start() and m.end() <= b or (m.start() <= a and b <= m.end() and m.end() - m.start() <= b - a + 2) for a, b in inside):
                    continue
                for stretch in sorted({(a, b) for _, got in options for a, b, _ in got}):
                    asked.append((i, m.start(), m.end(), (stretch, options)))
                    context.append(text[max(0, m.start() + stretch[0] - 1) : m.start() + stretch[1] + 1])
        if not asked:
            return []
        edits: dict[int, list[tuple[int, int, str, int]]] = {}
        for (i, at, _, ((a, b), options)), s in zip(asked, self.m.scores(context), strict=True):
            # the chain that the classifier holds most likely of those that decode this stretch strictly
            got = [(k, x[2]) for k, stretches in options for x in stretches if x[:2] == (a, b)]
            k, fixed = max(got, key=lambda o: s[o[0]])
            # one restored character of two bytes needs the classifier's word; more evidence needs it not to object
            few = sum(ord(c) > 127 for c in fixed) == 1 and max(fixed) < "\u0800"
            if s[k] >= s[0] + (self.margin if few else -3 * self.margin):
                edits.setdefault(i, []).append((at + a, at + b, fixed, k))
        for i, found in edits.items():
            text, out, last = now[i], [], 0
            # of stretches that overlap the longest counts
            taken: list[tuple[int, int, str, int]] = []
            for e in sorted(found, key=lambda e: e[0] - e[1]):
                if all(e[1] <= x[0] or x[1] <= e[0] for x in taken):
                    taken.append(e)
            for a, b, fixed, k in sorted(taken):
                out += [text[last:a], fixed]
                last = b
                chains[i].append(CHAINS[k - 1])
            now[i] = "".join([*out, text[last:]])
        return list(edits)

    def _undo_swaps(self, now: list[str], chains: list[list[str]], todo: list[int]) -> None:
        """Undo the sentences that one encoding read as another explains."""
        spans: list[tuple[int, int, int]] = []
        for i in todo:
            for m in SENTENCE.finditer(now[i]):
                if not m[0].isascii() and "\ufffd" not in m[0] and not QUOTED.sub("", m[0]).isascii():
                    spans.append((i, *m.span()))
        if not spans:
            return
        before = [now[i][a:b] for i, a, b in spans]
        score = self.m.scores(before)
        n, likely = np.nonzero(score[:, self.swaps] > score[:, :1])
        tries, undone = [], []
        for j, k in zip(n.tolist(), self.swaps[likely].tolist(), strict=True):
            u = self.undo_swap(before[j], k)
            if u is not None and u != before[j]:
                tries.append((j, k))
                undone.append(u)
        if not tries:
            return
        # the classifier must also find the restored sentence far more like intact text
        gain = self.m.scores(undone)[:, 0] - score[[j for j, _ in tries], 0]
        best: dict[int, tuple[float, int, str]] = {}
        for (j, k), u, g in zip(tries, undone, gain.tolist(), strict=True):
            if g > self.swap_margin and (j not in best or score[j, k] > best[j][0]) and self._more_words(before[j], u, g):
                best[j] = (float(score[j, k]), k, u)
        # a document that was read wrongly in one sentence most likely was in others: there less evidence will do
        chain_of: dict[int, Counter] = {}
        for j, (_, k, _) in best.items():
            chain_of.setdefault(spans[j][0], Counter())[k] += 1
        more: list[tuple[int, int, str]] = []
        for j, (i, _, _) in enumerate(spans):
            if i in chain_of and j not in best:
                k = chain_of[i].most_common(1)[0][0]
                u = self.undo_swap(before[j], k)
                if u is not None and u != before[j]:
                    more.append((j, k, u))
        if more:
            gain = self.m.scores([u for *_, u in more])[:, 0] - score[[j for j, *_ in more], 0]
            best |= {j: (0.0, k, u) for (j, k, u), g in zip(more, gain.tolist(), strict=True) if g > 0}
        for j in sorted(best, reverse=True):
            i, a, b = spans[j]
            now[i] = now[i][:a] + best[j][2] + now[i][b:]
            chains[i].append(CHAINS[best[j][1] - 1])

    def _more_words(self, before: str, after: str, gain: float) -> bool:
        """Whether what changed became words in use (or, without spaces between words, characters in use); where no
        words changed the classifier alone must be sure."""
        ideographs = [c for c in after if ord(c) >= 0x3000]
        if len(ideographs) >= 4:
            return sum(c in self.m.known for c in ideographs) >= 0.8 * len(ideographs)
        old, new = (Counter(w for w in WORD.findall(x)) for x in (before, after))
        # a letter by itself is no evidence
        gone, come = ([w for w in x.elements() if len(w) > 1] for x in (old - new, new - old))
        if any("\x80" <= c <= "\x9f" and c != "\x85" for c in after):
            return False
        # a word counts as in use if it is clearly more common than what it was read as
        common = max((self.m.seen(w) for w in gone if not w.isascii() or len(w) > 2), default=0)
        good = sum(self.m.seen(w) > max(self.in_use, 4 * common) for w in come)
        if come:
            return good >= 0.5 * len(come) and (gain > self.alone or not all(w.isascii() for w in come))
        changed = {(a, b) for a, b in zip(before, after, strict=False) if a != b}
        return gain > self.alone and not gone and len(before) == len(after) and all(b in TYPOGRAPHIC and a not in TYPOGRAPHIC and a < "\u0180" for a, b in changed)

    def undo_swap(self, sentence: str, k: int) -> str | None:
        table = _swap_table(CHAINS[k - 1])
        if table is not None:
            try:
                return "".join([c if c < "\x80" else table[ord(c)] for c in sentence])
            except KeyError:
                return None
        a, _, b = CHAINS[k - 1].partition(":")[2].partition(">")
        try:
            return bytes(_encoder(b)[c] for c in sentence).decode(a)
        except (KeyError, UnicodeDecodeError):
            return None


def training_sentences(docs: DataFrame, sample_docs: int = 8_192, per_doc: int = 24) -> list[str]:
    """Sentences with a non-ASCII character of a sample of documents, by a hash of their ids; both bounds limit the training alone."""
    n = docs.count()
    rows = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(max(n, 1))) < sample_docs)).select("text").limit(2 * sample_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            for t in b.column(0).to_pylist():
                if not t.isascii():
                    s = [m[0][:400] for m in SENTENCE.finditer(t) if not m[0].isascii()]
                    out += s[:: max(1, len(s) // per_doc)][:per_doc]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["s"])

    return sorted(set(rows.mapInArrow(cut, "s string").toArrow()["s"].to_pylist()))


def corpus_statistics(docs: DataFrame, known_least: int = 3) -> tuple[set[str], np.ndarray]:
    """Over all documents: the characters that at least known_least of them use, and for each word, by its hash, how many
    use it. The first can't outgrow Unicode, the second has a fixed size."""
    texts = docs.select("text").filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    chars = texts.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\x00-\x7f]+", ""), ""))).alias("c"))
    known = {r.c for r in chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= known_least).collect()}
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}'’]+|['’](?:(?<![\p{L}\p{M}].)|(?![\p{L}\p{M}]))"))).alias("w")).filter("w <> ''")
    got = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(WORD_BUCKETS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(WORD_BUCKETS, np.int32)
    counts[got["b"].to_numpy()] = np.minimum(got["n"].to_numpy(), np.iinfo(np.int32).max)
    return known, counts


def restore_encoding(docs: DataFrame, model: Classifier | None = None, **kw: int) -> DataFrame:
    """doc_id, chains, restored, is_lossy for each document that holds wrongly decoded text, wholly or in places.

    docs: doc_id, text; other columns are ignored. restored is the text with every run undone that can be; is_lossy says
    that some can't. Null, empty and plain ASCII texts are intact, as are quoted examples. Whole texts are read.
    """
    model = model or train(training_sentences(docs, **kw), statistics=corpus_statistics(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        det = Detector(model)
        for b in batches:
            # so many texts at a time as the scores of their sentences take little memory
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids, texts = column(part, "doc_id"), [t or "" for t in column(part, "text").to_pylist()]
                found = [(i, *r) for i, r in enumerate(det.process(texts)) if r[1] or r[2]]
                if found:
                    at, fixed, chains, lost = zip(*found, strict=True)
                    cols = [ids.take(pa.array(at)), pa.array([sorted(set(c)) for c in chains], pa.list_(pa.string())), pa.array(fixed, pa.string()), pa.array([bool(x) for x in lost])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "chains", "restored", "is_lossy"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chains array<string>, restored string, is_lossy boolean")
