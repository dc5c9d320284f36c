"""SentencePiece vocabularies and encoding of marked words over a shared-prefix trie.

Distinct marked words (``▁`` for a space) of a batch are sorted, which is a depth-first walk of
their trie. One forward state per prefix length is kept on a stack, and a word starts from the states
of the prefix that it shares with its predecessor. A state names its last piece, and so the prefix before
it: a word's ids are spelled once, back from its end, and memory is linear in the longest word.

* Unigram vocabularies: the state is the best score of the prefix and its last piece (Viterbi).
* BPE vocabularies: scores are merge ranks, and a sum of them means nothing; the best segmentation is
  the one that merging gives. It has the same recursion: the segmentation of a prefix ends in exactly
  one piece that fits the segmentation of the shorter prefix before it, and whether two adjacent
  pieces fit is a property of the pair. So the state is that last piece.

Both give what the sentencepiece library gives, as the tests check.
"""

from __future__ import annotations

import re

import numpy as np
import sentencepiece

MARK = "▁"


class Vocabulary:
    """Pieces, scores and special ids of a model file's contents."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind, self.size = kind, sp.get_piece_size()
        self.bytes = np.zeros(256, "<i4")
        self.ids: dict[str, int] = {}
        self.score: dict[int, float] = {}
        self.surface: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[i] = sp.get_score(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        lengths: dict[str, set] = {}
        for piece in self.ids:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        #: lengths of the pieces that end in a character, longest first
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.worst = min(self.score.values(), default=0.0) - 10.0
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: characters that no piece holds never merge, and may end a word
        self.breaks = "".join(c for c in "\n\t\r" if c not in lengths)
        stop = re.escape(self.breaks)
        self.words = re.compile(f"[^{stop}]+|[{stop}]" if inner else f"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+|[{stop}]" if stop else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: the best-scored adjacent pair first, leftmost on ties."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def mark(self, text) -> str:
        """The text as the encoder sees it: one space before it, spaces marked. Empty stays empty."""
        return f" {text}".replace(" ", MARK) if text else ""

    def fallback(self, char: str) -> bytes:
        """Byte pieces of a character outside the vocabulary, as packed ids."""
        return self.bytes[list(char.encode("utf-8", "surrogatepass"))].tobytes()


class TrieEncoder:
    """Encodes sorted batches of distinct words; remembers fits of pairs, and some words."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 100_000, most_pairs: int = 500_000, most_steps: int = 200_000):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.learnt: dict[tuple, int] = {}
        self.most_words, self.most_pairs, self.most_steps = most_words, most_pairs, most_steps
        if vocabulary.kind == "bpe":
            self.pieces = {p: i for p, i in vocabulary.ids.items() if len(p) == 1 or vocabulary.merge(p) == [p]}
        else:
            self.pieces = vocabulary.ids
        self.automaton()
        self.packed = [i.to_bytes(4, "little") for i in range(vocabulary.size)]
        self.text = {i: p for p, i in vocabulary.ids.items()}
        self.long = {i: len(p) for p, i in vocabulary.ids.items()}

    def automaton(self) -> None:
        """The pieces' automaton: after each character its state knows all pieces that end there, longest first.

        ``steps`` are a state's known transitions, ``fail`` its longest proper suffix that is a state.
        """
        self.steps: list[dict] = [{}]
        own = [-1]
        for piece, i in self.pieces.items():
            state = 0
            for c in piece:
                to = self.steps[state].get(c)
                if to is None:
                    to = self.steps[state][c] = len(own)
                    self.steps.append({})
                    own.append(-1)
                state = to
            own[state] = i
        self.fail, self.ends, depth = [0] * len(own), [()] * len(own), [0] * len(own)
        self.steps_left = self.most_steps
        queue = [0]
        for state in queue:
            for c, to in self.steps[state].items():
                depth[to] = depth[state] + 1
                # suffixes are shorter, so their states are done
                self.fail[to] = self.suffix_step(state, c) if state else 0
                longer = ((depth[to], own[to]),) if own[to] >= 0 else ()
                self.ends[to] = longer + self.ends[self.fail[to]]
                queue.append(to)

    def suffix_step(self, state: int, c: str) -> int:
        """Where a character leads from the longest suffix of a state that it can follow."""
        while state:
            state = self.fail[state]
            to = self.steps[state].get(c)
            if to is not None:
                return to
        return 0

    def advance(self, state: int, c: str) -> int:
        """A transition outside the trie of pieces; remembered while there is room."""
        to = self.suffix_step(state, c)
        if self.steps_left > 0 and c in self.v.lengths:
            self.steps_left -= 1
            self.learnt[state, c] = to
        return to

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives these two pieces again."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            found = self.pairs[key] = self.v.merge(a + b) == [a, b]
        return found

    def encode(self, words: set) -> dict[str, bytes]:
        """Ids of each word as little-endian 32-bit bytes."""
        out = {}
        todo = []
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                todo.append(w)
            else:
                out[w] = ids
        todo.sort()
        walk = self.walk_bpe if self.v.kind == "bpe" else self.walk_unigram
        # per prefix length: its last piece (-1: a character outside the vocabulary), its score or automaton state
        before, last, more = "", [-1], [0]
        for w in todo:
            shared = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            walk(w, shared, last, more)
            out[w] = self.spelled(w, last)
            before = w
        if len(self.known) < self.most_words:
            self.known.update((w, out[w]) for w in todo[: self.most_words - len(self.known)] if len(w) < 16)
        return out

    def spelled(self, w: str, last: list) -> bytes:
        """The ids of a word, from the last pieces of its prefixes."""
        packed, long, at, parts = self.packed, self.long, len(w), []
        while at:
            p = last[at]
            if p >= 0:
                parts.append(packed[p])
                at -= long[p]
            else:
                at -= 1
                parts.append(self.v.fallback(w[at]))
        parts.reverse()
        return b"".join(parts)

    def walk_bpe(self, w: str, shared: int, last: list, states: list) -> None:
        """Extend the forward states from ``shared`` characters to the whole word."""
        fit_of, fits, steps, ends, learnt = self.pairs.get, self.fits, self.steps, self.ends, self.learnt.get
        del states[shared + 1 :]
        state = states[-1]
        for i, c in enumerate(w[shared:], shared + 1):
            to = steps[state].get(c)
            if to is None:
                to = learnt((state, c))
                if to is None:
                    to = self.advance(state, c)
            state = to
            states.append(state)
            for n, p in ends[state]:
                left = last[i - n]
                # nothing before it, or a character that never merges
                if left >= 0:
                    fit = fit_of(left << 32 | p)
                    if not (fits(left, p) if fit is None else fit):
                        continue
                last.append(p)
                break
            else:
                last.append(-1)

    def walk_unigram(self, w: str, shared: int, last: list, scores: list) -> None:
        """The same with the best sum of scores as the state."""
        pieces, lengths, score = self.pieces, self.v.lengths, self.v.score
        del scores[shared + 1 :]
        for i in range(shared + 1, len(w) + 1):
            piece, best = -1, scores[i - 1] + self.v.worst
            for n in lengths.get(w[i - 1], ()):
                p = pieces.get(w[i - n : i]) if n <= i else None
                if p is not None and scores[i - n] + score[p] > best:
                    piece, best = p, scores[i - n] + score[p]
            last.append(piece)
            scores.append(best)


def decode(ids, vocabulary: Vocabulary) -> bytes:
    """The UTF-8 text of a sequence of ids, without the space that encoding put before it."""
    out = b"".join(map(vocabulary.surface.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out
