"""Recall of random tokens by alphabet and length in a sensitive context, and tokens that aren't random."""

import random
import string
import uuid

import pytest

from textloom.llm import secrets

HEX = "0123456789ABCDEF"
ALPHABETS = {
    "base62": string.ascii_letters + string.digits,
    "HEX": HEX,
    "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "letters": string.ascii_letters,
    "lower": string.ascii_lowercase,
    "digits": string.digits,
}
CONTEXT = "auth header reads: Bearer "


def recall(tokens):
    tool = secrets.Novelty()
    # 32 digits or more are a hex span by the fixed patterns
    return sum((len(CONTEXT), len(CONTEXT) + len(t)) in [s[1:] for s in secrets.secret_spans(CONTEXT + t + " rest", tool)] for t in tokens) / len(tokens)


@pytest.mark.parametrize("kind", ALPHABETS)
@pytest.mark.parametrize("length", [16, 20, 24, 32, 64, 128, 512])
def test_random_tokens_are_found(kind, length):
    rng = random.Random(length)
    assert recall(["".join(rng.choices(ALPHABETS[kind], k=length)) for _ in range(100)]) >= 0.9


def test_uuids_are_found():
    rng = random.Random(1)
    assert recall([str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(100)]) >= 0.9


def test_words_and_repeats_are_not():
    clean = "internationalization ResponsibilitiesOfTheOwner get_user_name_from_request telecommunications-department aaaaaaaaaaaaaaaaaaaaaaaa abcabcabcabcabcabcabc 0000000000000000000000 ==================== verantwortungsbewusstsein configurationManagerFactory".split()
    tool = secrets.Novelty()
    assert [t for t in clean if secrets.secret_spans(CONTEXT + t + " rest", tool)] == []
