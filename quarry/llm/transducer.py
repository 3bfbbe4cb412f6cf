"""Token counts by a compiled finite-state transducer.

A byte-fallback BPE vocabulary is compiled into a deterministic transducer over characters. A state
holds what later characters can still change: each suffix of the text that is a proper start of a
piece, with the token that ends before it and how many tokens the text gained since. A transition is
annotated with the tokens it adds (a merge may take some away), so the sum over a text's path is its
token count. That a token sequence is the BPE result exactly if each neighbouring pair is makes one
last token per position enough. States are compiled when first reached and kept in a table of bounded
size.

Texts are cut into chunks without regard to words. Two neighbouring characters that no piece contains
are a synchronising boundary: the state after it doesn't depend on what came before. Each chunk's
state map is thus a head, still to be run from the entry state, and a fixed exit state and count; all
chunks run in lock step, and the maps of a text compose in a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, table, text_or_empty

FREE = -1
#: Tokens are compared by what may follow them where at most so many pieces do.
ALIKE_PIECES = 100
SPACE = "▁"
#: Entries of the transition table, after which compilation starts anew.
TABLE_ENTRIES = 1 << 23


class Vocabulary:
    """The normal pieces of a SentencePiece BPE model, as far as counting needs them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.pieces = list(self.score)
        self.number = {p: k for k, p in enumerate(self.pieces)}
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.chars = {c for p in self.pieces for c in p}
        self.longer: dict[str, list[int]] = {}  # a proper start of pieces -> those pieces
        for k, p in enumerate(self.pieces):
            for n in range(1, len(p)):
                self.longer.setdefault(p[:n], []).append(k)
        self._spines: dict[int, tuple[list, list]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._alike: dict[tuple, int | None] = {}
        self._seen: dict[tuple[int, str], int | None] = {}

    def encode(self, text: str) -> list[str]:
        """Merge the best-scored neighbouring pair, the leftmost of equals, until none is a piece."""
        return [text[a:b] for a, b, *_ in self._trees(text)]

    def _trees(self, text: str) -> list[tuple]:
        """The merge trees of ``text``: (begin, end, left, right)."""
        parts: list[tuple] = [(k, k + 1, None, None) for k in range(len(text))]
        while len(parts) > 1:
            best = max(((self.score[m], -k) for k in range(len(parts) - 1) if (m := text[parts[k][0] : parts[k + 1][1]]) in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], parts[k], parts[k + 1])]
        return parts

    def whole(self, token: int) -> bool:
        """True if the piece, as a text, is one token."""
        return len(self._spine(token)[0]) > 0

    def _spine(self, token: int) -> tuple[list, list]:
        """The parts that grow into ``token`` along its right and its left edge, smallest first, with scores."""
        if token not in self._spines:
            p, sides = self.pieces[token], []
            for side in (3, 2):
                tree, grown = self._trees(p), []
                node = tree[0] if len(tree) == 1 else None
                while node:
                    part = p[node[0] : node[1]]
                    grown.append((part, self.score[part] if len(part) > 1 else np.inf))
                    node = node[side]
                sides.append(grown[::-1])
            self._spines[token] = tuple(sides)
        return self._spines[token]

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens stay as they are next to each other: no parts at the seam merge first.

        Merges happen in order of score, as a merge never has a better score than its parts. A part at
        the seam thus lives from its own score down to that of the part it grows into.
        """
        if left == FREE:
            return True
        if (left, right) not in self._fits:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            a, b = self._spine(left)[0], self._spine(right)[1]
            i = j = 0
            ok = True
            while ok:
                to_a = a[i + 1][1] if i + 1 < len(a) else -np.inf
                to_b = b[j + 1][1] if j + 1 < len(b) else -np.inf
                seam = self.score.get(a[i][0] + b[j][0])
                if seam is not None and seam > to_a and seam >= to_b:
                    ok = False
                elif to_a == to_b == -np.inf:
                    break
                elif to_a >= to_b:
                    i += 1
                else:
                    j += 1
            self._fits[left, right] = ok
        return self._fits[left, right]

    def alike(self, last: int, suffix: str) -> int | None:
        """A token that the same pieces starting with ``suffix`` can follow as ``last``; None if none can."""
        if last == FREE:
            return FREE
        if len(self.longer[suffix]) > ALIKE_PIECES:
            return last
        if (last, suffix) not in self._seen:
            if len(self._seen) > 1_000_000:
                self._seen.clear()
            follow = tuple(k for k in self.longer[suffix] if self.fits(last, k) and self.whole(k))
            self._seen[last, suffix] = self._alike.setdefault((suffix, follow), last) if follow else None
        return self._seen[last, suffix]


class Transducer:
    """Counts tokens of many texts at once; ``counts`` is its one public method."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = 512, table_entries: int = TABLE_ENTRIES) -> None:
        self.v, self.chunk, self.entries = vocabulary, chunk, table_entries
        self.start = ("", ((0, FREE, 0),))
        self.class_of = np.full(0x110000, -1, np.int32)
        self.symbols: list[str | int] = [1, 2, 3, 4]  # classes 0 to 3: characters of no piece, by UTF-8 length
        self.width = 128
        self._grow_pairs()
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.rows = 1024
        self.next = np.full(self.rows * self.width, -1, np.int32)
        self.emit = np.zeros(self.rows * self.width, np.int8)
        self._state(self.start)

    def _grow_pairs(self) -> None:
        self.joins = np.zeros((self.width, self.width), bool)

    def _state(self, s: tuple) -> int:
        if s not in self.index:
            if len(self.states) == self.rows:
                self.rows *= 2
                more = self.rows * self.width
                self.next = np.concatenate([self.next, np.full(more - len(self.next), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros(more - len(self.emit), np.int8)])
            self.index[s] = len(self.states)
            self.states.append(s)
        return self.index[s]

    def _classes(self, cps: np.ndarray) -> np.ndarray:
        got = self.class_of[cps]
        if (got < 0).any():
            for cp in np.unique(cps[got < 0]):
                c = chr(cp)
                if c in self.v.chars:
                    self.class_of[cp] = len(self.symbols)
                    self.symbols.append(c)
                else:
                    self.class_of[cp] = len(c.encode("utf-8", "surrogatepass")) - 1
            if len(self.symbols) > self.width:
                while len(self.symbols) > self.width:
                    self.width *= 2
                self._grow_pairs()
                self._reset()
            known = [(i, c) for i, c in enumerate(self.symbols) if isinstance(c, str)]
            place = dict((c, i) for i, c in known)
            self.joins[:] = False
            for p in self.v.pairs:
                if p[0] in place and p[1] in place:
                    self.joins[place[p[0]], place[p[1]]] = True
            got = self.class_of[cps]
        return got

    def _compile(self, state: int, symbol: int) -> None:
        """One transition, by the only token that can end at the new position."""
        v, c = self.v, self.symbols[symbol]
        suffix, open_at = self.states[state]
        if isinstance(c, int):
            to, added = self.start, c
        else:
            token, kept = None, []
            for length, last, since in open_at:
                if length == 0 and last != FREE and v.pieces[last][-1] + c not in v.pairs:
                    last = FREE
                longer = suffix[len(suffix) - length :] + c
                k = v.number.get(longer)
                if token is None and k is not None and v.whole(k) and v.fits(last, k):
                    added, token = 1 - since, k
                if longer in v.longer and (last := v.alike(last, longer)) is not None:
                    kept.append((length + 1, last, since))
            if token is None:
                raise ValueError("the vocabulary isn't closed under merges")
            open_to = (*((n, last, since + added) for n, last, since in kept), (0, token, 0))
            longest = open_to[0][0]
            to = ((suffix + c)[len(suffix) + 1 - longest :], open_to)
        n = self._state(to)
        self.next[state * self.width + symbol] = n
        self.emit[state * self.width + symbol] = added

    def _run(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of lanes classes[begin : begin + length] entered in ``state``, in lock step."""
        order = np.argsort(-length, kind="stable")
        at, left, st = begin[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        steps = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(steps), side="left")
        for j in range(steps):
            n = active[j]
            symbols = classes[at[:n] + j]
            cell = st[:n] * self.width + symbols
            to = self.next[cell]
            missing = to < 0
            if missing.any():
                for key in np.unique(cell[missing]):
                    self._compile(int(key) // self.width, int(key) % self.width)
                to = self.next[cell]
            count[:n] += self.emit[cell]
            st[:n] = to
        out_state, out_count = np.empty_like(st), np.empty_like(count)
        out_state[order], out_count[order] = st, count
        return out_state, out_count

    def _counts(self, marked: list[str]) -> np.ndarray:
        if self.rows * self.width > self.entries:
            self._reset()
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        cps = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cps):
            return np.zeros(len(marked), np.int64)
        classes = self._classes(cps)
        doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # Chunks: begin, end, document; the first boundary in each that its state map starts anew from.
        per_doc = -(-sizes // self.chunk)
        doc = np.repeat(np.arange(len(marked)), per_doc)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        begin = doc_start[doc] + nth * self.chunk
        end = np.minimum(begin + self.chunk, doc_start[doc] + sizes[doc])
        synced = np.ones(len(cps) + 1, bool)
        synced[1:-1] = ~self.joins[classes[:-1], classes[1:]]
        place = np.flatnonzero(synced)
        sync = np.minimum(place[np.searchsorted(place, begin)], end)
        sync[nth == 0] = begin[nth == 0]
        fixed = sync < end  # this chunk's exit doesn't depend on its entry
        zero = np.zeros(len(doc), np.int64)
        exit_state, count = self._run(classes, sync, end - sync, zero)
        # Scan: heads whose entry is known run in lock step; a chunk that is all head waits for the one before.
        head = sync - begin
        done = head == 0
        ready = fixed.copy()
        while not done.all():
            now = np.flatnonzero(~done & np.concatenate([[False], ready[:-1]]))
            s, n = self._run(classes, begin[now], head[now], exit_state[now - 1])
            count[now] += n
            exit_state[now] = np.where(fixed[now], exit_state[now], s)
            done[now] = ready[now] = True
        return np.bincount(doc, count, minlength=len(marked)).astype(np.int64)

    def _pieces(self, text: str, group: int) -> Iterator[str]:
        """A text as the model sees it, in pieces of about ``group`` characters that end at synchronising boundaries.

        After such a boundary the state is the start, so pieces' counts add up. Text without any is one piece.
        """
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        k = 0
        while k < len(marked):
            n = min(k + group, len(marked))
            while n < len(marked) and marked[n - 1 : n + 1] in self.v.pairs:
                n += 1
            yield marked[k:n]
            k = n

    def counts(self, texts: list[str], group: int = 1_000_000) -> np.ndarray:
        """Tokens of each text, in groups of about ``group`` characters; a longer text goes through several."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            np.add.at(out, owners, self._counts(held))
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for piece in self._pieces(text, group):
                if held and size + len(piece) > group:
                    flush()
                    size = 0
                held.append(piece)
                owners.append(k)
                size += len(piece)
        if held:
            flush()
        return out


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This process's transducer of a model; compiled states serve all its tasks."""
    if path not in _compiled:
        _compiled[path] = Transducer(Vocabulary(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, repeated or not; null
    doc_id stays null. Very long texts are cut into chunks, never truncated.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            n = t.counts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
