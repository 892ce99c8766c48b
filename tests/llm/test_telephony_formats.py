"""A-law and ADPCM recordings are stored, read back and resampled as mu-law ones are."""

import numpy as np
import pytest

from tideline.llm import telephony as t


@pytest.mark.parametrize("law", [6, 7, 17])
def test_each_format_gives_resampled_samples(spark, law):
    text = "some words of a recording " * 60
    row = t.telephony(spark.createDataFrame([(1, text)], "doc_id long, text string"), law=law).first()
    p = t.pad(text.encode())
    data = np.frombuffer(p, np.uint8)
    want = {6: t.A_LAW[data], 7: t.MU_LAW[data], 17: t.decode_adpcm(data).ravel()}[law].astype(int)
    assert t.load(bytes(row["media"])) == p and bytes(row["media"])[20] == law
    got = np.frombuffer(bytes(row["pcm"]), "<i2")
    assert got[::2].tolist() == want.tolist()
    assert got[1:-1:2].tolist() == ((want[:-1] + want[1:]) >> 1).tolist() and got[-1] == want[-1]


def test_a_short_last_block_of_adpcm():
    data = bytes(range(72)) + bytes(range(20))
    got = t.samples(t.store(data, law=17))
    assert len(got) == 137 + 1 + 2 * 16
    assert got[:137].tolist() == t.decode_adpcm(np.frombuffer(data[:72], np.uint8)).ravel().tolist()
    assert got[137:].tolist() == t.decode_adpcm(np.frombuffer(data[72:], np.uint8), 20).ravel().tolist()
