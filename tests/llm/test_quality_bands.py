"""Encoded and random text against the compression limits."""

import base64
import random

import numpy as np

from addrloom.llm import quality

PRESS = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
RNG = np.random.default_rng(5)


def b64(n):
    return base64.encodebytes(RNG.bytes(n))[:n]


def printable(n):
    return bytes(RNG.integers(33, 127, n, dtype=np.uint8))


def hexes(n):
    return RNG.bytes(n).hex()[:n].encode()


def random_words(n):
    rng = random.Random(n)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n // 3))[:n].encode()


def test_encoded_text_is_outside_each_band():
    # below 1,000 bytes random words, and below 2,800 hex digits, compress like prose: the ratio cannot tell them
    for make, least in ((b64, 400), (printable, 400), (random_words, 1000), (hexes, 2800)):
        for n in [b[0] for b in quality.BANDS if b[0] >= least] + [50_000]:
            assert not quality.band_verdict(make(n + 50), PRESS)[0], (make.__name__, n)


def test_short_texts_and_parts_are_judged():
    prose = open(quality.__file__).read().encode()
    assert all(not quality.band_verdict(make(n), PRESS)[0] for make in (b64, printable) for n in (130, 200, 300, 390))
    words = b" ".join(sorted(set(prose.split()), key=lambda w: quality.zstandard.ZstdCompressor().compress(w)))
    for n in (1700, 20_000):
        text = (words * (n // len(words) + 1))[:n]
        assert not quality.band_verdict(text + printable(n), PRESS)[0] and not quality.band_verdict(printable(n) + text, PRESS)[0]
    assert quality.band_verdict(b"", PRESS) == (True, None, 0)


def zipf(letters, lengths, sep=""):
    """20,000 bytes and more of words drawn by Zipf's law, of characters drawn by a flatter one."""
    rng = np.random.default_rng(7)
    share = lambda k, a: (w := 1 / np.arange(1, k + 1) ** a) / w.sum()
    found, sizes = rng.choice(letters, size=40_000, p=share(len(letters), 0.9)), rng.choice(lengths, 12_000)
    words = ["".join(found[at : at + k]) for at, k in zip(np.cumsum(sizes) - sizes, sizes)]
    drawn = rng.choice(words, size=12_000, p=share(12_000, 1.0))
    return "".join(sep.join(drawn[k : k + 12]) + (". " if sep else "\u3002") for k in range(0, 12_000, 12)).encode()


def test_other_scripts_are_kept_and_their_noise_is_not():
    chinese = [chr(0x4E00 + 7 * k % 5000) for k in range(3500)]
    cyrillic, hangul, greek = [chr(0x430 + k) for k in range(32)], [chr(0xAC00 + 37 * k % 11_000) for k in range(1200)], [chr(0x3B1 + k) for k in range(24)]
    for letters, lengths, sep in ((chinese, [1, 2, 2, 3], ""), (hangul, [2, 3, 3], " "), (cyrillic, [2, 3, 4], " "), (greek, [2, 3, 4], " ")):
        text = zipf(letters, lengths, sep)
        for n in (1100, 1700, 3000, 4500, 9000, 40_000):
            for at in range(0, 4 * 300, 300):
                good, ratio, outside = quality.band_verdict(text[at : at + n], PRESS)
                assert good, (letters[0], n, ratio, outside)
    # random letters of two bytes compress like prose: the ratio cannot tell them
    for n in (1100, 4500, 40_000):
        assert not quality.band_verdict("".join(RNG.choice(chinese, size=n // 3)).encode(), PRESS)[0]
    assert not quality.band_verdict(zipf(chinese, [1, 2, 2, 3])[:6000] + printable(6000), PRESS)[0]
