import random
import string

import pytest

from shelfmark.llm import secret_scan

HEX, UPPER, ALNUM = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits


@pytest.mark.parametrize("alphabet, length, before, kind", [
    (HEX, 24, "", "hex"), (HEX, 32, "", "hex"), (HEX, 40, "", "hex"), (HEX, 64, "", "hex"), (UPPER, 16, "AKIA", "access"),
    (HEX, 16, "password=", "assign"), (HEX, 20, "see ", "token"), (HEX.upper(), 32, "see ", "token"), (ALNUM, 20, "see ", "token"),
    (ALNUM, 40, "see ", "token"), (ALNUM, 16, "secret: ", "assign"), (ALNUM + "+/", 40, "token=", "assign")])
def test_random_values_of_each_kind_look_random(alphabet, length, before, kind):
    rng, missed = random.Random(length), 0
    for _ in range(2000):
        value = "".join(rng.choice(alphabet) for _ in range(length))
        if kind in ("token", "assign") and not any(c.isdigit() for c in value):
            continue  # a value without a digit does not count, as the module says
        found = [c for c in secret_scan.candidates((before + value).encode()) if c[2] == kind]
        missed += not (found and found[0][4])
    assert missed <= 4


def test_values_that_are_not_random():
    for value in (b"0" * 40, b"deadbeef" * 5, b"AKIA" + b"A" * 16, b"1" * 30, b"hello_world_and_more_words", b"a1" * 12):
        assert not secret_scan._random(value)


def test_owner_specific_keys_are_masked(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choice(HEX) for _ in range(24)) for _ in range(60)]
    keys += ["AKIA" + "".join(rng.choice(UPPER) for _ in range(16)) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"key {k} end", f"s{i}") for i, k in enumerate(keys)], "doc_id bigint, text string, source string")
    assert {r.text for r in secret_scan.mask(docs).collect()} == {"key [secret] end"}
