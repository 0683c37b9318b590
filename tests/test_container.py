"""Help containers: chains of blocks out of order, broken ones, and the topics read from them."""

import io
import random
import zipfile

from codeloom.sources import dump


def container(payload, sizes, seed=3, name="FileStorage", last=0x7FFFFFFF):
    """A container whose payload is cut into blocks that lie in a random order with gaps between them."""
    cuts, at = [], 0
    for size in sizes:
        cuts.append(payload[at : at + size])
        at += size
    cuts.append(payload[at:])
    data = bytearray(dump.TABLE + dump.ENTRIES * dump.ENTRY)
    record = len(data)
    data += bytes(dump.NAME_AT) + name.encode("utf-16-le") + b"\0\0"
    order = list(range(len(cuts)))
    random.Random(seed).shuffle(order)
    place = {}
    for i in order:
        data += b"-" * (i % 5)
        place[i] = len(data)
        data += bytes(dump.HEADER) + cuts[i]
    for i, part in enumerate(cuts):
        following = place[i + 1] if i + 1 < len(cuts) else last
        data[place[i] : place[i] + dump.HEADER] = f"\r\n{len(payload):08x} {len(part):08x} {following:08x} \r\n".encode()
    entry = dump.TABLE + 2 * dump.ENTRY
    data[entry : entry + 8] = record.to_bytes(4, "little") + place[0].to_bytes(4, "little")
    return bytes(data)


def pages():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("Массив/Добавить.html", "<h1>Добавить</h1>")
        z.writestr("readme.txt", "no page")
        z.writestr("b.HTM", "<title>b</title>" * 200)
    return raw.getvalue()


def test_blocks_out_of_order():
    for seed in range(8):
        payload = bytes(random.Random(seed).randbytes(900))
        assert dump.stored_files(container(payload, [1, 0, 300, 77, 200], seed)) == payload
    assert dump.stored_files(container(b"x" * 50, [])) == b"x" * 50


def test_broken_containers():
    good = container(b"abc" * 30, [10, 20])
    assert dump.stored_files(container(b"abc", [1], name="Other")) is None and dump.stored_files(b"") is None and dump.stored_files(bytes(200)) is None
    circle = container(b"abcdef", [2, 2], last=0)
    first = int.from_bytes(circle[dump.TABLE + 2 * dump.ENTRY + 4 :][:4], "little")
    assert dump.stored_files(circle.replace(b"00000000 \r\n", f"{first:08x} \r\n".encode())) == b"abcdef"
    assert dump.stored_files(good[:-5]) is not None


def test_topics(spark):
    files = {"a.hbk": container(pages(), [5, 600, 40, 1]), "cut.hbk": container(pages(), [5, 600])[:400], "none.hbk": b"nothing", "empty.hbk": b""}
    rows = sorted((r.path, r.html[:20]) for r in dump.topics_of_archives(dump.in_memory(spark, files)).collect())
    assert rows == [("b.HTM", "<title>b</title><tit"), ("Массив/Добавить.html", "<h1>Добавить</h1>")]
