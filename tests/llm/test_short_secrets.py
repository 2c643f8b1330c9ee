"""Random tokens of every encoding and length are found, prose-like ones are not."""

import random

from lexatlas.llm import secret_scan

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
WORDS = "the quick brown fox jumps over lazy dogs while international committees consider several reports about water energy schools and music erstens zwischen werden maison toujours ciudad siempre".split()


def planted(rng, name, n):
    while True:
        token = "".join(rng.choices(ALPHABETS[name], k=n))
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and (name != "base64" or set("+/") & set(token)):
            return token


def likenesses(rng):
    """Slugs, camel case and capitals with a number in them, 20 to 60 characters."""
    a = rng.choices(WORDS, k=rng.randint(4, 8))
    number = str(rng.randint(1, 2030))
    words = ["-".join(a[:2] + [number] + a[2:]), a[0] + "".join(w.capitalize() for w in a[1:]) + number, ("_".join(a) + "_" + number).upper(), "".join(a).upper() + number[:1].replace("1", "2").replace("8", "3").replace("9", "4")]
    return [w for w in words if 20 <= len(w) <= 60]


def test_random_tokens_of_each_length_are_found(spark):
    rng = random.Random(8)
    true = [(name, n, planted(rng, name, n)) for name in ALPHABETS for n in (20, 24, 32, 40) for _ in range(100)]
    false = [w for _ in range(300) for w in likenesses(rng)] + [f"{rng.randrange(10**19):019d}{c}{rng.randrange(10**3)}" for c in "abcdef" for _ in range(15)]
    rows = [(k, f"see {t} here") for k, t in enumerate([t for _, _, t in true] + false)]
    found = {r.doc_id for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() if len(r.spans)}
    share = {(name, n): sum(k in found for k, (e, l, _) in enumerate(true) if (e, l) == (name, n)) / 100 for name in ALPHABETS for n in (20, 24, 32, 40)}
    wrong = sum(k >= len(true) for k in found)
    print(share, wrong, len(false))
    assert all(s >= (0.5 if name == "hex" else 0.9) for (name, n), s in share.items()), share
    assert wrong <= 0.02 * len(found), wrong
