"""A merge-type SentencePiece vocabulary: normalisation, proven segment boundaries, agenda encoding.

Loaded once in each Python worker. The library is the judge of what is right: the rules used here
(how text is normalised, where a token boundary is certain) are derived from the vocabulary and from
probes of the library's own normaliser, and a model that they don't fit takes the plain path.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array

SPACE = "▁"
PROBES = ("", " ", "a", " a  b ", "Åﬁ① Ａ 　x\ty\ńz­​\r\n", "A\u0000B ▁ c")


class PieceVocabulary:
    """Pieces and scores of a model, and what can be proven about its token boundaries."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.piece_id = {sp.id_to_piece(i): i for i in plain}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown_id, self.end_id = sp.unk_id(), sp.eos_id()
        self.simple = all(sp.normalize(p) == self.spaced(p) for p in PROBES)
        inside = {p[k : k + 2] for p in self.piece_id for k in range(len(p) - 1)}
        #: No piece holds a word sign after another character, so a token always starts there.
        word_starts = not any(b == SPACE != a for a, b in inside)
        #: No piece of several characters holds a line feed, so it is always a token of its own.
        feed_alone = not any("\n" in pair for pair in inside)
        self.segmented = self.simple and word_starts and feed_alone and len(sp.encode("\n")) == 2
        self._runs = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*").findall

    @staticmethod
    def spaced(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def normalised(self, text: str) -> str:
        return self.spaced(text) if self.simple else self.library.normalize(text)

    def keys(self, text: str) -> list[str]:
        """A text cut at certain token boundaries. A key is a segment: after a word sign, or from a line feed on.

        A key that starts with a line feed stands for itself, any other for a word sign and the key. Single
        spaces, by far the usual case, need no pattern.
        """
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [s if s[0] == "\n" else s[1:] for s in self._runs(self.spaced(text))]
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def slices(text: str, most: int = 1 << 20):
        """Cut a very long text at single spaces, which go: the next slice's own word sign stands for the space."""
        start, n = 0, len(text)
        while n - start > most:
            cut = text.rfind(" ", start + 1, start + most)
            while cut > start and (text[cut - 1] in " " + SPACE or text[cut + 1] in " " + SPACE):
                cut = text.rfind(" ", start + 1, cut)
            if cut <= start:  # none in reach: look further on
                cut = start + most
                while cut < n - 1 and not (text[cut] == " " and text[cut - 1] not in " " + SPACE and text[cut + 1] not in " " + SPACE):
                    cut += 1
                if cut >= n - 1:
                    break
            yield text[start:cut]
            start = cut + 1
        yield text[start:]

    def key_ids(self, key: str) -> list[int]:
        return self.agenda_ids(key if key[:1] == "\n" else SPACE + key)

    def agenda_ids(self, text: str) -> list[int]:
        """Ids of a normalised text by a score-ordered agenda of adjacent symbol pairs.

        The agenda gives the best-scored pair, ties to the left; merging it puts its two new neighbours there.
        For a short text it is a flat list, one place for each pair; for a long one a heap, where an entry
        whose symbols have changed since is stale and skipped.
        """
        if len(text) > 48:
            return self._ids(self._heap_agenda(text))
        symbols, get, never = list(text), self.rank.get, 1e18
        agenda = [get(a + b, never) for a, b in zip(text, text[1:])]
        while agenda and (best := min(agenda)) < never:
            k = agenda.index(best)
            symbols[k] = pair = symbols[k] + symbols.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = get(pair + symbols[k + 1], never)
            if k:
                agenda[k - 1] = get(symbols[k - 1] + pair, never)
        return self._ids(symbols)

    def _heap_agenda(self, text: str) -> list[str | None]:
        n = len(text)
        symbols: list[str | None] = list(text)
        rank, put, take = self.rank, heapq.heappush, heapq.heappop
        agenda = [(rank[pair], k, pair) for k in range(n - 1) if (pair := text[k : k + 2]) in rank]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, left, pair = take(agenda)
                held = symbols[left]
                if held is None or (right := after[left]) >= n or len(held) + len(symbols[right]) != len(pair) or held + symbols[right] != pair:
                    continue
                symbols[left], symbols[right] = pair, None
                after[left] = beyond = after[right]
                if beyond < n:
                    before[beyond] = left
                    if (joined := pair + symbols[beyond]) in rank:
                        put(agenda, (rank[joined], left, joined))
                if (prior := before[left]) >= 0 and (joined := symbols[prior] + pair) in rank:
                    put(agenda, (rank[joined], prior, joined))
        return symbols

    def _ids(self, symbols: list[str | None]) -> list[int]:
        out: list[int] = []
        known = self.piece_id
        for symbol in symbols:
            if symbol is not None:
                if (found := known.get(symbol)) is not None:
                    out.append(found)
                elif self.byte_id:
                    out += [self.byte_id[b] for b in symbol.encode()]
                elif not out or out[-1] != self.unknown_id:
                    out.append(self.unknown_id)
        return out

    def library_ids(self, keys: list[str]) -> list[list[int]]:
        """The library's ids of keys, each as it would be inside a text. It adds a word sign of its own."""
        found = self.library.encode(keys, num_threads=1)
        alone = self.piece_id.get(SPACE)
        return [ids[1:] if key[:1] == "\n" else ids if key else [alone] for key, ids in zip(keys, found, strict=True)]

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()


class KeyMemo:
    """What is known of keys, in two generations: words in use move to the young one, the rest is let go.

    Holds at most about twice ``most`` bytes, whatever the corpus; ``fill`` computes values of new keys, all at once.
    """

    #: Longer keys are not kept; bytes of a kept key, its own among them, besides its value's.
    LONG, EACH = 64, 216

    def __init__(self, fill, most: int = 32 << 20) -> None:
        self.fill, self.most = fill, most
        self.clear()

    def clear(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def values(self, keys: list[str]) -> list:
        out = list(map(self.young.get, keys))
        if None in out:
            lacking = dict.fromkeys(k for k, v in zip(keys, out, strict=True) if v is None)
            if self.old:
                lacking = dict(zip(lacking, map(self.old.get, lacking), strict=True))
            if new := [k for k, v in lacking.items() if v is None]:
                lacking.update(zip(new, self.fill(new), strict=True))
            out = [lacking[k] if v is None else v for k, v in zip(keys, out, strict=True)]
            kept = {k: v for k, v in lacking.items() if len(k) <= self.LONG}
            size = len(kept) * self.EACH + sum(map(len, kept.values()))
            if self.held + size > self.most:
                self.old, self.young, self.held = self.young, {}, 0
            if size <= self.most:
                self.young.update(kept)
                self.held += size
        return out


@functools.cache
def vocabulary(model_file: str) -> PieceVocabulary:
    return PieceVocabulary(model_file)
