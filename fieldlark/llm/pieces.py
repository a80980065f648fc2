"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

A row of tokens is what the merges give if and only if each token survives its
own merges and each adjacent pair does: re-merging the pair's text gives the
pair. So a text is encoded from the left, longest match first (Aho-Corasick), a
candidate being taken if it is compatible with the token before; where no
candidate is left the position is marked as failed in a bitfield and the last
token gives way to its next shorter one. Each position fails once at most.

Merges never join what no piece of the vocabulary holds side by side, so a text
is cut where the model has such borders (before white space, at unknown
characters), and parts met before are looked up.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pairs and parts kept in a worker's memos; they change no result.
PAIRS, MEMO = 400_000, 800_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class _Bits:
    """A field of n bits, all zero at first."""

    def __init__(self, n: int):
        self.raw = bytearray(n // 8 + 1)

    def __getitem__(self, i: int) -> int:
        return self.raw[i >> 3] >> (i & 7) & 1

    def __setitem__(self, i: int, one: int) -> None:
        self.raw[i >> 3] |= 1 << (i & 7)


class Model:
    """The parts of a model file that encoding and decoding need."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, trained = m.normalizer_spec, m.trainer_spec
        if trained.model_type != trained.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or not trained.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and the identity normaliser are read")
        if any(p.type in (_USER, _UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not read")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.score = {p.piece: p.score for p in m.pieces if p.type == _NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == _NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.end = trained.eos_id
        self.unknown_surface = trained.unk_surface
        self.chars = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [p]:  # what its own merges do not give never occurs
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cut = self._borders()

    def _borders(self) -> re.Pattern | None:
        """Finds parts that no merge crosses: a run of spaces with what follows it, unknown control characters and
        what ends in a letter before a mark that no piece holds behind a letter."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            return None
        lone = "".join(c for c in "\n\r\t" if c not in self.chars) or "\0"
        letter, other = r"[^\W\d_]", rf"[^{SPACE}{lone}]"
        behind = {c for p in self.id for c in re.findall(rf"(?<={letter})[^\w]", p)}
        stops = "".join(re.escape(c) for c in string.punctuation if c not in behind and c != "_")
        if not stops:
            return re.compile(rf"[{lone}]|{SPACE}+{other}*|{other}+")
        plain = rf"[^{SPACE}{lone}{stops}]*+"
        return re.compile(rf"[{lone}]|(?=.){SPACE}*+[{stops}]*+{plain}(?:(?<!{letter})[{stops}]++{plain})*+", re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """The merges as such: the best-scored adjacent pair first, the leftmost of equals."""
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether merges leave the two tokens as they are beside each other."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            got = self.pairs[key] = self.merge(x + y) == [x, y]
        return got

    def _known(self, text: str) -> list[int]:
        """Ids of a text of which every character is a piece."""
        n = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(text):
            found[end - size + 1].append((end + 1, i))  # shorter ones end earlier, so they come first
        failed = bytearray(n + 1) if n < 256 else _Bits(n + 1)  # in short texts a byte for a bit is quicker
        pairs = self.pairs
        ids: list[int] = []
        path: list[tuple[int, int, int]] = []
        at, k, last = 0, len(found[0]) - 1, -1
        while at < n:
            here = found[at]
            while k >= 0:
                end, i = here[k]
                if not failed[end]:
                    if last < 0:
                        break
                    ok = pairs.get(last << 32 | i)
                    if self.fits(last, i) if ok is None else ok:
                        break
                k -= 1
            if k >= 0:
                path.append((at, k, last))
                ids.append(i)
                at, last = end, i
                k = len(found[at]) - 1 if at < n else -1
            else:
                failed[at] = 1
                if not ids:
                    raise ValueError("the vocabulary does not cover this text")
                ids.pop()
                at, k, last = path.pop()
                k -= 1
        return ids

    def _part(self, part: str) -> list[int]:
        if self.chars.issuperset(part):
            return self._known(part)
        ids: list[int] = []
        run = 0
        for i, c in enumerate(part):
            if c not in self.chars:
                if run < i:
                    ids += self._known(part[run:i])
                ids += [self.byte[b] for b in c.encode()]
                run = i + 1
        if run < len(part):
            ids += self._known(part[run:])
        return ids

    def split(self, text: str) -> list[str]:
        """The normalised text in parts that are encoded each by itself."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        return self.cut.findall(text) if self.cut else [text]

    def encode(self, text: str) -> list[int]:
        """Ids without an end id."""
        return [i for p in self.split(text) for i in self._part(p)]

    def decode_bytes(self, ids) -> list[bytes | int]:
        """What each id stands for: text in UTF-8, or a single byte's value."""
        out: list[bytes | int] = []
        for i in ids:
            kind = self.kinds[i]
            if kind == _BYTE:
                out.append(int(self.pieces[i][1:-1], 16))
            elif kind == _UNKNOWN:
                out.append(self.unknown_surface.encode())
            elif kind != _CONTROL:
                out.append(self.pieces[i].replace(SPACE, " ").encode())
        return out

    def decode(self, ids) -> str:
        """The library's text: the space put before all is taken off, broken byte runs become U+FFFD each."""
        text, run = [], bytearray()
        first = True
        for x in self.decode_bytes(ids):
            if isinstance(x, int):
                run.append(x)
                first = False
                continue
            if run:
                text.append(_utf8(bytes(run)))
                run.clear()
            s = x.decode()
            if first and self.prefix and s.startswith(" ") and s != self.unknown_surface:
                s = s[1:]
            first = False
            text.append(s)
        if run:
            text.append(_utf8(bytes(run)))
        return "".join(text)


def _utf8(raw: bytes) -> str:
    """Valid characters as they are, each other byte as one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_by_path: dict[str, "Coder"] = {}


class Coder:
    """Whole documents through a model: per part, the ids as text and what they decode to."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.memo = _Parts(self.model)

    def document(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a space, decoded text), with the end id."""
        found = list(map(self.memo.__getitem__, self.model.split(text)))
        self.memo.age()
        ids = "".join([f[0] for f in found]) + str(self.model.end)
        decoded = "".join([f[1] for f in found])
        return ids.count(" ") + 1, ids, decoded[1:] if self.model.prefix and decoded else decoded


class _Parts(dict):
    """Of each part met of late: its decimal ids, each with a space behind, and the text that they decode to."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}
        self.listed = [f"{i} " for i in range(len(model.pieces))]
        self.surface = [None if isinstance(x[0], int) else x[0].decode() for x in ((model.decode_bytes([i]) or [b""]) for i in range(len(model.pieces)))]

    def __missing__(self, part: str) -> tuple[str, str]:
        got = self.old.get(part)
        if got is None:
            ids = self.model._part(part)
            # parts are whole characters, so each decodes by itself; the space before all is taken off once, at the end
            shown = [self.surface[i] for i in ids]
            if None in shown:
                shown = [b"".join(bytes([x]) if isinstance(x, int) else x for x in self.model.decode_bytes(ids)).decode()]
            got = "".join([self.listed[i] for i in ids]), "".join(shown)
        if len(part) <= 64:
            self[part] = got
        return got

    def age(self) -> None:
        if len(self) > MEMO // 2:
            self.old = dict(self)
            self.clear()


def coder(path: str) -> Coder:
    """One per worker process and model."""
    if path not in _by_path:
        _by_path[path] = Coder(path)
    return _by_path[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` the ids and the decoded text too.

    An end id follows the text's. A null text is the empty one: its end id alone,
    decoded to nothing. Rows that repeat repeat in the result; other columns are
    not read; an empty table gives an empty result.
    """
    ddl = CODED + (", ids array<int>, decoded string" if ids else "")

    def run(batches):
        schema, own = common.batches_of(ddl), coder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in common.sliced(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, listed, decoded = own.document(text)
                out.append((doc, n, sha(listed), sha(decoded)) + (([int(i) for i in listed.split()], decoded) if ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, ddl)
