"""Vocabulary files of public tokenizers, found by name; loaded once in each Python process."""

from __future__ import annotations

import functools
import json
import os

import public_tokenizers
from tokenizers import Tokenizer


def path(name: str) -> str:
    return public_tokenizers.path(name)


@functools.cache
def load(file: str) -> Tokenizer:
    """The tokenizer in file. A task has its core for itself, so the library starts no threads unless the environment asks for them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(file)


@functools.cache
def without_rules(file: str, mark: str) -> Tokenizer:
    """The vocabulary and merges in file, for normalised pre-tokens with a mark between them."""
    spec = definition(file)
    parts = [
        {"type": "Split", "pattern": {"String": mark}, "behavior": "Isolated", "invert": False},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    ]
    plain = spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": parts}}
    return Tokenizer.from_str(json.dumps(plain))


def definition(file: str) -> dict:
    """The file's contents; not kept, as they are large."""
    with open(file, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def special_strings(file: str) -> list[str]:
    return [t["content"] for t in definition(file)["added_tokens"]]


@functools.cache
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
