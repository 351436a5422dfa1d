"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A task marks its texts and splits them into words, sorts the distinct ones and
walks them as a trie, depth first: consecutive words keep the forward states
of their common prefix, and only the rest of a word is searched. The state of
a prefix is its best segmentation's score and last piece; an automaton of all
pieces gives those that end at each character.

For a unigram model, a segmentation's score is the sum of its pieces' scores.
For a byte-pair model, whose scores are merge ranks and add up to nothing, a
segmentation scores 0 where every two neighbouring pieces are ones that
merging would leave side by side, and minus infinity otherwise; just one
segmentation of each prefix scores 0, and it is the one that merging gives. So
both kinds of model yield the library's ids by the same search. Runs of two or
more spaces, whose pieces share one rank in byte-pair models, are merged
directly.

Words have numbers, and the ids of a number stand in one Arrow list array: the
ids of a slice of texts are one ``take`` of it, and decoding is one ``take`` of
the pieces' bytes.

Defined cases: a null text has null ids and decodes to null; an empty text has
no ids; a character that no piece holds becomes its UTF-8 bytes' pieces; the
mark itself (U+2581) in a text decodes to a space, as in the library; very long
words are searched in time linear in their length.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textguard.llm.shingles import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What ends a prefix whose last character is no piece.
RAW = -1
_NEVER = float("inf")


class Pieces:
    """The pieces of a SentencePiece model file and the searches over them."""

    MOST_WORDS = 125_000
    MOST_PAIRS = 500_000
    LONG_WORD = 64

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        normalizer = spec.normalizer_spec
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces or not normalizer.add_dummy_prefix:
            raise ValueError("only models that mark the start and leave texts as they are otherwise (identity normalisation) are supported")
        self.merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [-1] * 256
        decoded = []
        self.scores = [0.0] * n
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                decoded.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                self.ids[name] = i
                self.scores[i] = sp.get_score(i)
                decoded.append(name.replace(MARK, " ").encode())
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.bytes = pa.array(decoded, pa.large_binary())
        self.sizes = np.array([len(x) for x in decoded], np.int64)
        self.lengths = [len(x) for x in self.names]
        # when merging makes a piece; characters are there from the start
        self.ranks = [-_NEVER if len(x) == 1 else -s for x, s in zip(self.names, self.scores, strict=True)]
        self.unknown = sp.unk_id()
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in self.ids):
            raise ValueError("models with pieces that span words or lines are not supported")
        # no piece holds a line feed: words end there as well
        self.split = re.compile(f"\n+|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.stay: dict[int, bool] = {}
        self.trees: dict[int, tuple[int, int] | None] = {}
        self.start_over()
        self.before, self.before_ids, self.before_ends = {}, array("i"), array("i", [0])

    def start_over(self) -> None:
        """No words known; those of just before still are, one turn longer."""
        if hasattr(self, "index"):
            self.before, self.before_ids, self.before_ends = self.index, self.flat, self.ends
        # words seen lately: their numbers; the ids of all numbers in a row, and where each number's end
        self.index: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("i", [0])

    def merged(self, text: str) -> list[str]:
        """The pieces that byte-pair merging leaves."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves, always taking the best-scored merge, leftmost first; and the last merge."""
        parts, latest = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts, latest
            latest = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def tree(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one, (RAW, RAW) for a character. None if
        merging does not make it, or makes it or a part of it before one of its parts' parts."""
        if piece not in self.trees:
            name, found = self.names[piece], None
            if len(name) == 1:
                found = (RAW, RAW)
            else:
                left, latest = self._merge(name)
                if left == [name]:
                    a, b = (self.ids[x] for x in latest)
                    if self.tree(a) and self.tree(b) and self.ranks[piece] > max(self.ranks[a], self.ranks[b]):
                        found = (a, b)
            self.trees[piece] = found
        return self.trees[piece]

    def stays(self, a: int, b: int) -> bool:
        """Whether merging leaves these pieces side by side.

        Their merges are undone from the last to the first. The two pieces that
        then stand at the border would be joined if their own merge came before
        the one undone that took either of them.
        """
        names, of, ranks, trees = self.names, self.ids.get, self.ranks, self.trees
        if not (self.tree(a) and self.tree(b)):
            x, y = names[a], names[b]
            return self.merged(x + y) == [x, y]
        left = right = _NEVER
        x, y, ra, rb = names[a], names[b], ranks[a], ranks[b]
        while True:
            k = of(x + y)
            # of equal merges, the leftmost is first
            if k is not None and ranks[k] < left and ranks[k] <= right:
                return False
            if ra > rb:
                left, a = ra, trees[a][1]
                x, ra = names[a], ranks[a]
            elif rb > -_NEVER:
                right, b = rb, trees[b][0]
                y, rb = names[b], ranks[b]
            else:
                return True

    def search(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the sorted words."""
        return self._by_merges(words) if self.merges else self._by_scores(words)

    def _by_merges(self, words: list[str]) -> Iterator[list[int]]:
        found, get, wide, lengths = self.automaton.iter, self.stay.get, len(self.names), self.lengths
        # of each prefix of the word before, the last piece; how many prefixes have one
        last: list[int] = [RAW]
        push = last.append
        before = ""
        for word in words:
            have = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                have += 1
            del last[have + 1 :]
            for end, (piece, n) in found(word):
                if end < have:
                    continue  # shared with the word before, or the one piece that may end here is known
                while end > have:  # a character that is no piece
                    push(RAW)
                    have += 1
                if n <= end:
                    a = last[end + 1 - n]
                    if a >= 0:
                        ok = get(a * wide + piece)
                        if ok is None:
                            ok = self._remembered(a, piece)
                        if not ok:
                            continue
                push(piece)
                have += 1
            end = len(word)
            while have < end:
                push(RAW)
                have += 1
            before, out = word, []
            while end:
                piece = last[end]
                if piece < 0:
                    out += self.raw_ids(word[end - 1])[::-1]
                    end -= 1
                else:
                    out.append(piece)
                    end -= lengths[piece]
            out.reverse()
            yield out

    def _by_scores(self, words: list[str]) -> Iterator[list[int]]:
        last: list[int] = [RAW]
        total: list[float] = [0.0]
        before = ""
        for word in words:
            shared = len(os.path.commonprefix([before, word]))
            del last[shared + 1 :], total[shared + 1 :]
            ending: dict[int, list[tuple[int, int]]] = {}
            for end, match in self.automaton.iter(word):
                ending.setdefault(end, []).append(match)
            for end in range(shared, len(word)):
                options = [(total[end + 1 - n] + self.scores[piece], piece) for piece, n in ending.get(end, ())]
                if word[end] not in self.ids:
                    options.append((total[end] + self.least, RAW))
                best, piece = max(options, key=lambda x: x[0])
                total.append(best)
                last.append(piece)
            before, out, end = word, [], len(word)
            while end:
                piece = last[end]
                out += [piece] if piece >= 0 else self.raw_ids(word[end - 1])[::-1]
                end -= self.lengths[piece] if piece >= 0 else 1
            yield out[::-1]

    def _remembered(self, a: int, b: int) -> bool:
        if len(self.stay) >= self.MOST_PAIRS:
            self.stay.clear()
        ok = self.stay[a * len(self.names) + b] = self.stays(a, b)
        return ok

    def raw_ids(self, text: str) -> list[int]:
        """The ids of characters that no piece holds."""
        if self.byte_ids[0] < 0:
            return [self.unknown] * len(text)
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def _of_word(self, word: str) -> list[int]:
        """The ids of a word that is not searched: a run of line feeds, or a word after two
        or more marks. In ranks, pieces of marks alone come last: the rest of such a word,
        with the last mark, merges first."""
        if word[0] == "\n":
            return self.raw_ids(word)
        body = word.lstrip(MARK)
        run = len(word) - len(body)
        if not body:
            return self._marks(run)
        tail = next(iter(self.search([MARK + body])))
        if tail[0] == self.ids.get(MARK):
            return self._marks(run) + tail[1:]
        return self._marks(run - 1) + tail

    def _marks(self, n: int) -> list[int]:
        """A run of marks, merged from the left as equal ranks go."""
        block = max((len(p) for p in self.ids if set(p) == {MARK}), default=1)
        k = max(n // block - 4, 0)  # whole blocks of the longest piece of marks come first
        rest = self.merged(MARK * (n - k * block))
        return [self.ids.get(p, self.unknown) for p in [MARK * block] * k + rest]

    def learn(self, tokens: set[str]) -> list[str]:
        """Numbers for tokens without one; those of them that are new. A token is what
        stands between spaces: it stands for a mark and its text or, if a line feed
        begins it, for its text alone."""
        before, old, cuts = self.before, self.before_ids, self.before_ends
        for t in tokens.intersection(before):
            k = before[t]
            self._add(t, old[cuts[k] : cuts[k + 1]])
        fresh = sorted(tokens.difference(self.index))
        direct = MARK + MARK if self.merges else None
        odd = {t for t in fresh if "\n" in t or t[:1] == " "}
        plain = [MARK + t for t in fresh if t not in odd] if odd else [MARK + t for t in fresh]
        index, flat, ends = self.index, self.flat, self.ends
        for w, ids in zip(plain, self.search(plain), strict=True):
            index[w[1:]] = len(ends) - 1
            flat.extend(ids)
            ends.append(len(flat))
        if odd:
            parts = {t: self.split.findall(t if t[0] == "\n" else MARK + t.replace(" ", MARK)) for t in odd}
            special = lambda w: w[0] == "\n" or direct is not None and w.startswith(direct)
            words = sorted({w for ws in parts.values() for w in ws if not special(w)})
            ids = dict(zip(words, self.search(words), strict=True))
            for t, ws in parts.items():
                self._add(t, list(chain.from_iterable(self._of_word(w) if special(w) else ids[w] for w in ws)))
        return fresh

    def _add(self, token: str, ids: list[int]) -> None:
        self.index[token] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        if len(self.index) > self.MOST_WORDS or len(self.flat) > 8 * self.MOST_WORDS:
            self.start_over()
        lists = [tokens(t) if t else [] for t in texts]
        new = self.learn(set(chain.from_iterable(lists)).difference(self.index))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int32, int(counts.sum()))
        known = pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), pa.array(np.frombuffer(self.flat, np.int32)))
        taken = known.take(pa.array(numbers))
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = pa.array(taken.offsets.to_numpy()[ends].astype(np.int32))
        values = taken.values
        for t in new:
            if len(t) > self.LONG_WORD:
                del self.index[t]
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array([t is None for t in texts]))

    def decode(self, ids: pa.ListArray) -> list[bytes | None]:
        """The UTF-8 of each text."""
        values, offsets = ids.values, ids.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(self.sizes[values.to_numpy()])])[offsets]
        held = memoryview(self.bytes.take(values).buffers()[2] or b"")
        out: list[bytes | None] = []
        for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist(), strict=True):
            # the mark of the start is no text
            out.append(bytes(held[a + (held[a : a + 1] == b" ") : b]) if ok else None)
        return out


def tokens(text: str) -> list[str]:
    """What stands between the spaces of a text, a line feed beginning a token of its
    own; spaces beyond the first begin the token after them, or are one."""
    out = text.replace(MARK, " ").replace("\n", " \n").split(" ")
    if "" not in out:
        return out
    kept, run = [], 0
    for x in out:
        if not x:
            run += 1
        elif x[0] == "\n":
            kept += [" " * (run - 1), x] if run else [x]
            run = 0
        else:
            kept.append(" " * run + x)
            run = 0
    return kept + [" " * (run - 1)] if run else kept


_loaded: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, read once in each Python worker."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def read_model(path: str | None = None) -> bytes:
    """The model file as the driver sees it. A few hundred kilobytes: it goes with the tasks."""
    with open(path or os.environ.get("TEXTGUARD_PIECES", MODEL), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, whether decoding the ids gives the
    text, and the columns to carry. Both ways in one task, so that a text crosses to Python once."""
    model = read_model(path)
    rest = [f for f in docs.schema if f.name in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for rows, texts in chunks(batch, most_chars=1_000_000):
                ids = pieces.encode(texts)
                exact = [x == (None if t is None else t.encode()) for t, x in zip(texts, pieces.decode(ids), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), ids, pa.array(exact), *(rows.column(f.name) for f in rest)],
                    names=["doc_id", "n_tokens", "ids", "exact", *(f.name for f in rest)],
                )

    kind = "doc_id long, n_tokens long, ids array<int>, exact boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select("doc_id", "text", *(f"`{f.name}`" for f in rest)).mapInArrow(run, kind)
