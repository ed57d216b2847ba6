"""Vocabulary files: `.tiktoken` ranks, tokenizer.json, SentencePiece `.model`; and the choice of a tokenizer for a model."""

from __future__ import annotations

import base64
import binascii
import json
import os
import struct
import tempfile
from pathlib import Path

from loomtally.functions.models import Model

Ranks = dict[bytes, int]
PieceRow = tuple[bytes, float, int]


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """A value and the place after it; ValueError if it is cut off or longer than 64 bits."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a varint is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if not byte & 0x80:
            return value, at
        shift += 7
        if shift >= 64:
            raise ValueError("a varint is too long")


def _fields(data: bytes):
    """(number, wire type, value) of a protobuf message, for the wire types 0, 1, 2 and 5."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = read_varint(data, at)
        elif wire == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("a field is cut off")
        yield number, wire, value


def parse_model(data: bytes) -> list[PieceRow]:
    """(piece, score, type) of every piece of a SentencePiece model."""
    out = []
    for number, wire, value in _fields(data):
        if number == 1 and wire == 2:
            piece, score, kind = b"", 0.0, 1
            for n, w, v in _fields(value):
                if n == 1 and w == 2:
                    piece = v
                elif n == 2 and w == 5:
                    score = struct.unpack("<f", v)[0]
                elif n == 3 and w == 0:
                    kind = v
            out.append((piece, score, kind))
    if not out:
        raise ValueError("no pieces")
    return out


def parse_tiktoken(text: str) -> Ranks:
    """One `base64 rank` a line; blank lines are skipped and any other bad line rejects the file."""
    out: Ranks = {}
    for line in text.splitlines():
        if not line.strip():
            continue
        token, rank = line.split()
        try:
            out[base64.b64decode(token + "=" * (-len(token) % 4), validate=True)] = int(rank)
        except binascii.Error as e:
            raise ValueError(f"bad token {token!r}") from e
    if not out:
        raise ValueError("no tokens")
    return out


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable in Latin-1, else those from U+0100 on in turn."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def parse_tokenizer_json(text: str) -> Ranks:
    """Byte strings and ranks: tokens made by merges in the order of the merges, after those that no merge makes. Without merges the id is the rank."""
    model = json.loads(text)["model"]
    value, merges = byte_alphabet(), model.get("merges") or []
    raw = lambda t: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
    order = {"".join(m.split(" ", 1) if isinstance(m, str) else m): i for i, m in reversed(list(enumerate(merges)))}
    out = {raw(t): (order[t] + len(model["vocab"]) if t in order else i) if merges else i for t, i in model["vocab"].items()}
    if not out:
        raise ValueError("no tokens")
    return out


def load_file(path: str | Path, engine: str):
    """("bpe", ranks) or ("sentencepiece", pieces) by the file's extension; None if it doesn't fit the engine or can't be read."""
    path = Path(path)
    try:
        if path.suffix == ".tiktoken":
            return "bpe", parse_tiktoken(path.read_text())
        if path.suffix == ".json":
            return "bpe", parse_tokenizer_json(path.read_text(encoding="utf-8"))
        if path.suffix == ".model" and engine == "sentencepiece":
            return "sentencepiece", parse_model(path.read_bytes())
    except (OSError, ValueError, KeyError, TypeError):
        return None
    return None


def tiktoken_cache(name: str) -> list[Path]:
    """Where a cached vocabulary of this name might lie."""
    roots = [os.environ[k] for k in ("TMPDIR", "TEMP", "TMP") if os.environ.get(k)] + [tempfile.gettempdir()]
    return [Path(r) / "data-gym-cache" / name for r in dict.fromkeys(roots)]


def choose_tokenizer(model: Model, folder: str | Path | None = None, any_file: bool = False, cache: bool = False):
    """The first loadable of: the model's own files in folder; with any_file, any vocabulary there, by path; with cache, cached files of a chat
    model; else ("approx", None)."""
    if folder and Path(folder).is_dir():
        names = [Path(folder) / n for n in model.vocab_files]
        if any_file:
            names += sorted(p for p in Path(folder).iterdir() if p.suffix in (".tiktoken", ".model", ".json"))
        for path in names:
            if path.is_file() and (found := load_file(path, model.engine)):
                return found
    if cache and model.name == "chatgpt":
        for name in model.vocab_files:
            for path in tiktoken_cache(name):
                if path.is_file() and (found := load_file(path, model.engine)):
                    return found
    return "approx", None
