"""Functions the user supplies, and deterministic stand-ins for tests.

Each takes and returns a pandas Series and runs on Arrow batches inside tasks. Heavy
objects (a model, a tokenizer) should be loaded on first use, so that each Python
worker loads them once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

Complete = Callable[[pd.Series], pd.Series]  # prompt -> text
Embed = Callable[[pd.Series], pd.Series]  # text -> list of floats
Tokenize = Callable[[pd.Series], pd.Series]  # text -> list of ints
Decode = Callable[[pd.Series], pd.Series]  # file bytes -> list of page texts


def decode_utf8_pages(content: pd.Series) -> pd.Series:
    """Pages of a text book: UTF-8, form feed between pages."""
    return content.map(lambda b: bytes(b).decode("utf-8").split("\f"))


def tokenize_code_points(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [ord(c) for c in t])


def embed_letter_counts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"])


def complete_echo_list(prompt: pd.Series) -> pd.Series:
    """Answers every prompt with a numbered list of its last line, twice."""
    return prompt.map(lambda p: f"1.{p.splitlines()[-1]}\n2.{p.splitlines()[-1]}")
