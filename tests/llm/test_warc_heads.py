"""Salvage finds intact records after damage however long their heads are."""

import io

from quarry.llm import warc


def test_record_with_a_long_head_after_damage_is_found():
    records = [warc.record(i, f"http://x/{'y' * n}", b"payload" * 20) for i, n in enumerate((1, 1, 20000, 1))]
    data = bytearray(b"".join(records))
    begin = len(records[0])
    data[begin + len(records[1]) - 20] ^= 0xFF
    found = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
    assert [k for k, *_ in found] == ["record", "gap", "record", "record"] and found[1][1:3] == (begin, begin + len(records[1]))
