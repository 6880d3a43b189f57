import zlib
from collections import Counter, defaultdict

from helpers import table, with_ids
from tunelake.llm import slots

TEXTS = [None, "", "same", "same", "ñ😀", "z" * 5000] + [f"text {n} " * (n % 40) for n in range(600)]


def test_every_row_has_its_place(spark):
    found = slots.sharded(table(spark, TEXTS)).collect()
    assert len(found) == len(TEXTS)
    load, taken = Counter(), defaultdict(list)
    for row in found:
        data = (TEXTS[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[row["shard"]] += row["size"]
        taken[row["shard"]].append(row["slot"])
    assert sorted(load) == list(range(16))
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 1 for t in TEXTS)
    assert all(sorted(places) == list(range(len(places))) for places in taken.values())


def test_equal_rows_get_different_places(spark):
    found = slots.sharded(with_ids(spark, [(7, "a")] * 5 + [(None, None)] * 2)).collect()
    assert len({(r["shard"], r["slot"]) for r in found}) == 7


def test_rebalancing_edits_the_map(spark):
    rows = slots.slot_rows(table(spark, TEXTS), 64)
    loads = slots.slot_loads(rows, 64)
    first = slots.first_map(loads, 4)
    second = slots.rebalanced(first, loads, 4)
    third = slots.rebalanced(second, loads, 5)
    sizes = {r["slot_no"]: r["bytes"] for r in loads.collect()}
    maps = [{r["slot_no"]: r["shard"] for r in m.collect()} for m in (first, second, third)]
    assert all(len(m) == 64 for m in maps) and {r["version"] for r in third.collect()} == {2}
    for held, count in ((maps[1], 4), (maps[2], 5)):
        load = [sum(sizes[s] for s in held if held[s] == n) for n in range(count)]
        assert max(load) - min(load) <= max(sizes.values())
    # A shard that exists before and after keeps most of its bytes.
    moved = sum(sizes[s] for s in sizes if maps[1][s] != maps[2][s])
    assert moved <= 0.45 * sum(sizes.values())


def test_empty_table(spark):
    assert slots.sharded(table(spark, [])).count() == 0
