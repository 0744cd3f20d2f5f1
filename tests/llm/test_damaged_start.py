"""Damage at the start of archives."""

import gzip
import hashlib
import random

import pytest

from tilesieve.llm import warc


def big_archive(compressed):
    r, out, starts = random.Random(3), b"", []
    for i in range(5):
        payload = r.randbytes(9000).hex().encode()
        if i == 0:
            payload = gzip.compress(b"a page in a page " * 50, mtime=0) + payload
        data = warc.record(i, f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), None) + warc.END
        starts.append(len(out))
        out += gzip.compress(data, mtime=0) + warc.EMPTY_MEMBER if compressed else data
    return out, starts


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("zeroed", [3, 16, 4096])
def test_damaged_start(compressed, zeroed):
    data, starts = big_archive(compressed)
    assert starts[1] > 4096
    found = list(warc.salvage(b"\0" * zeroed + data[zeroed:]))
    assert [f["page_id"] for _, _, f in found if isinstance(f, dict)] == [1, 2, 3, 4]
    assert found[0][0] == 0 and isinstance(found[0][2], str)
    assert all(b <= starts[1] for _, b, f in found if isinstance(f, str))
