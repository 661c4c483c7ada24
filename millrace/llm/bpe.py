"""BPE encoding and decoding (operator 6).

A text longer than `leaf` characters goes through tree concatenation, whatever is in it: it is halved into leaves at
any character, these are encoded, and on the way up each join is mended. A window of text around the join is encoded
anew and grows until it agrees exactly with both sides: on either side two neighbouring tokens, with their places, are
those of the window. Every two neighbours of the result then stand next to each other in an encoding of their own
text, which for merges by rank makes the result the encoding of the whole.

Leaves and short texts are cut at ASCII white space, which the tokenizer drops and its merges never cross; what lies
between is encoded once per worker and kept in a bounded table. Tokens with places are worked out near joins alone.

Defined results: a null text is the empty text; an empty text has no ids; rows and ids may repeat, one row out for
each row in; other columns of the input are not looked at.
"""

from __future__ import annotations

import gc
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, release_memory, table

TOKENIZER = "word_bpe_49k.json"
#: Texts beyond so many characters are encoded by halves.
LEAF = 4096
#: Signs that the tokenizer cuts off a letter or digit before them.
SIGNS = rb"""!"#$%&'()*+,-./:;=>?@[\]^_`{|}~"""
#: Characters on either side of a join in the first window.
WINDOW = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_SPACES = " \t\n\x0b\x0c\r"
#: Words beyond which a worker begins a new table of what it has learnt, once the rows at hand are done; it keeps two.
KNOWN = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Coder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, known: int = KNOWN):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        # A window at a cut within a special token must hold all of it.
        self.leaf, self.window, self.known = leaf, max([window, *(len(t.content) + 1 for t in self.tok.get_added_tokens_decoder().values())]), known
        #: For words, and for what is left of them without case and signs at the end: ids, text decoded from them, number of ids.
        self.words: dict[bytes, tuple[str, str, int]] = {}
        self.stems: dict[bytes, tuple[str, str, int]] = {}
        #: Full tables grow old: what is asked for again moves on to the new one, the rest goes with the next change.
        self.old_words: dict[bytes, tuple[str, str, int]] = {}
        self.old_stems: dict[bytes, tuple[str, str, int]] = {}
        #: Token of each id; without a decoder, decoding joins them by one space.
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.names = {i: t for t, i in vocabulary.items()} if self.tok.decoder is None else {}
        self.decimals = {i: str(i) for i in vocabulary.values()}
        #: Characters encoded for joins, and of the texts that they are in.
        self.again = self.treed = 0

    def forget(self) -> None:
        self.words, self.stems, self.old_words, self.old_stems = {}, {}, {}, {}

    def _plain(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, id) of the tokens of each text."""
        # A single text is not worth waking other threads for.
        found = [self.tok.encode(t, add_special_tokens=False) for t in texts] if len(texts) < 2 else self.tok.encode_batch(texts, add_special_tokens=False)
        return [[(x, y, i) for i, (x, y) in zip(e.ids, e.offsets, strict=True)] for e in found]

    def tree(self, text: str) -> list[tuple[str, str, int]]:
        """Entries, one after another, of a long text, as the tokenizer encodes the whole. Words that no join has touched are to be learnt already."""
        cuts = [*range(0, len(text), self.leaf), len(text)]
        parts = [(a, b, self._units(text, a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        # What a cut leaves of a word is encoded with the join; longer runs than a window as they are, all of them side by side.
        long = [(part, k) for _, _, part in parts for k in range(len(part)) if part[k][2] is None and part[k][1] - part[k][0] > 4 * self.window]
        for (part, k), tokens in zip(long, self._plain([text[part[k][0] : part[k][1]] for part, k in long]), strict=True):
            start, end, _ = part[k]
            part[k] = start, end, [(start + x, start + y, i) for x, y, i in tokens]
        while len(parts) > 1:
            parts = [self._join(text, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        self.treed += len(text)
        known, out = self.words, []
        for x, y, held in parts[0][2]:
            if held is None:
                out.append(known[text[x:y].encode()])
            elif held and isinstance(held[0], bytes):
                out += map(known.__getitem__, held)
            else:
                out.append(self._entry([i for _, _, i in held]))
        return out

    def _units(self, text: str, a: int, b: int) -> list:
        """A leaf's words, those beyond the first windows' reach of its ends as one run."""
        reach = 2 * self.window
        first, last = _GAP.search(text, a + reach, b - reach), _GAP.search(text, max(a + reach, b - 2 * reach), b - reach)
        words = text[first.end() : last.start()].encode().split() if first and last and first.end() < last.start() else []
        if not words or len(max(words, key=len)) > 4 * self.window:
            return [(m.start(), m.end(), None) for m in _WORD.finditer(text, a, b)]
        head, tail = ([(m.start(), m.end(), None) for m in _WORD.finditer(text, x, y)] for x, y in ((a, first.start()), (last.end(), b)))
        return [*head, (first.end(), last.start(), words), *tail]

    @staticmethod
    def _parted(text: str, units: list, k: int) -> int | None:
        """Puts the words of a run in its place; how many units that adds, None if it is no run."""
        start, end, held = units[k]
        if not held or not isinstance(held[0], bytes):
            return None
        units[k : k + 1] = [(m.start(), m.end(), None) for m in _WORD.finditer(text, start, end)]
        return len(held) - 1

    def _opened(self, text: str, unit) -> list[tuple[int, int, int]]:
        """The tokens of a unit, with their places."""
        start, end, tokens = unit
        if tokens is None:
            (found,) = self._plain([text[start:end]])
            self.again += end - start
            tokens = [(start + x, start + y, i) for x, y, i in found]
        return tokens

    def _join(self, text: str, left, right):
        """left and right: (start, end, units); a unit is (start, end, tokens), or None for the tokens of a word, a list of words for those of a run, as the table has them."""
        a, at, before = left
        _, b, after = right
        if text[at - 1] in _SPACES or text[at] in _SPACES:
            return a, b, before + after  # no token crosses white space
        size = self.window
        while True:
            lo, hi = max(a, at - size), min(b, at + size)
            # Tokens of either side within the window's reach.
            k, near = len(before), []
            while k and before[k - 1][1] > lo:
                if (more := self._parted(text, before, k - 1)) is not None:
                    k += more
                    continue
                k -= 1
                near = self._opened(text, before[k]) + near
            j, far = 0, []
            while j < len(after) and after[j][0] < hi:
                if self._parted(text, after, j) is not None:
                    continue
                far = far + self._opened(text, after[j])
                j += 1
            ((*own,),) = self._plain([text[lo:hi]])
            own = [(x + lo, y + lo, i) for x, y, i in own]
            self.again += hi - lo
            # Only between characters: within one the same byte may stand several times.
            pairs = {(x, y): i for i, (x, y) in enumerate(zip(own, own[1:], strict=False)) if x[1] <= y[0]}
            # Up to the first of two tokens that agree the left side's tokens hold, from there on the window's, and so at the right.
            first = (0, 0) if lo == a else next(((i + 1, pairs[p] + 1) for i, p in enumerate(zip(near, near[1:], strict=False)) if p in pairs), None)
            last = (len(far), len(own)) if hi == b else next(((i, pairs[far[i - 1], far[i]] + 1) for i in range(len(far) - 1, 0, -1) if (far[i - 1], far[i]) in pairs), None)
            if first and last and first[1] <= last[1]:
                if lo == a:
                    near, k, first = [], 0, (0, 0)
                if hi == b:
                    far, j, last = [], len(after), (0, len(own))
                tokens = near[: first[0]] + own[first[1] : last[1]] + far[last[0] :]
                return a, b, before[:k] + ([(tokens[0][0], tokens[-1][1], tokens)] if tokens else []) + after[j:]
            size *= 4

    def _short(self, words: list[tuple[bytes, str]]):
        """Ids of words encoded together with spaces between, dealt back by their offsets."""
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            e = self.tok.encode(" ".join([t for _, t in part]), add_special_tokens=False)
            ids, begins, k, end = e.ids, [x for x, _ in e.offsets], 0, -1
            for w, t in part:
                end += len(t) + 1
                j = k
                while j < len(begins) and begins[j] < end:
                    j += 1
                yield w, ids[k:j]
                k = j

    def _entry(self, ids: list[int]) -> tuple[str, str, int]:
        shown = " ".join([self.names[i] for i in ids]) if self.names else self.tok.decode(ids, skip_special_tokens=False)
        return " ".join([self.decimals[i] for i in ids]), shown, len(ids)

    @staticmethod
    def _renewed(wanted: set[bytes], old: dict, new: dict) -> set[bytes]:
        """Moves to the new table what the old one has."""
        found = wanted & old.keys()
        for w in found:
            new[w] = old[w]
        return found

    def learn(self, words) -> None:
        """Adds words to the table. The tokenizer lowers letters and cuts signs off them, so most words share a stem."""
        stems, known = self.stems, self.words
        whole, cut, new = [], [], set()
        for w in words:
            if w.isalpha() and self.names:  # ASCII letters alone, most words
                stem = w.lower()
                whole.append((w, stem))
                new.add(stem)
                continue
            stem, tail = w, b""
            if b"<" not in w and self.names:
                stem = w.lower()
                core = stem.rstrip(SIGNS)
                if len(core) < len(stem) and core[-1:].isalnum():
                    stem, tail = core, stem[len(core) :]
            cut.append((w, stem, tail))
            new.add(stem)
            new.add(tail)
        new.difference_update(stems)
        new -= self._renewed(new, self.old_stems, stems)
        tokenize, entry, others = self.tok.model.tokenize, self._entry, []
        for w in new:
            if not w:
                stems[w] = ("", "", 0)
            elif w.isalpha() and w.islower():
                stems[w] = entry([t.id for t in tokenize(w.decode())])
            else:
                others.append((w, w.decode()))
        for w, ids in self._short(others):
            stems[w] = entry(ids)
        for w, stem in whole:
            known[w] = stems[stem]
        for w, stem, tail in cut:
            got = stems[stem]
            if tail:
                a, b, n = stems[tail]
                got = (f"{got[0]} {a}", f"{got[1]} {b}", got[2] + n)
            known[w] = got

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text the ids in decimals, the text decoded from them, and their number."""
        split = [t.encode().split() for t in texts]  # bytes.split() cuts at ASCII white space alone
        if len(self.words) > self.known:
            self.words, self.old_words = {}, self.words
        if len(self.stems) > self.known:
            self.stems, self.old_stems = {}, self.stems
        known = self.words
        missing = set()
        for t, words in zip(texts, split, strict=True):
            new = set(words).difference(known)
            missing |= new if len(t) <= self.leaf else {w for w in new if len(w) <= 16 * self.window}  # bytes, of at most four a character
        missing -= self._renewed(missing, self.old_words, known)
        if missing:
            self.learn(missing)
        out = []
        for t, words in zip(texts, split, strict=True):
            got = [g for g in (self.tree(t) if len(t) > self.leaf else map(known.__getitem__, words)) if g[2]]
            decimals, shown, counts = zip(*got, strict=True) if got else ((), (), ())
            out.append((" ".join(decimals), " ".join(shown), sum(counts)))
        return out


#: The worker's coder. Its vocabulary stays for the worker's next tasks; what it has learnt goes with each.
_CODERS: dict[tuple[str, int], Coder] = {}


def coder_for(path: str, leaf: int = LEAF) -> Coder:
    if (path, leaf) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, leaf] = Coder(path, leaf)
    return _CODERS[path, leaf]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, n_tokens long, ids_text string, decoded string): ids_text holds the ids in decimals, joined by one space; ids() gives them as an array."""

    def run(batches):
        import pyarrow as pa

        coder = coder_for(path, leaf)
        gc.disable()  # the tables hold no cycles, and walking them costs more than all else
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    rows = coder.encode([t or "" for t in part.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                        ["id", "n_tokens", "ids_text", "decoded"],
                    )
        finally:
            coder.forget()
            gc.enable()
            release_memory()

    modest_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_text string, decoded string").withColumnRenamed("id", id_col)


def ids(ids_text: F.Column) -> F.Column:
    return F.when(ids_text == "", F.array().cast("array<int>")).otherwise(F.split(ids_text, " ").cast("array<int>"))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), default_path()))
