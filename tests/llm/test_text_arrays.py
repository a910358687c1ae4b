import numpy as np
import pyarrow as pa

from dyadics.llm.near_dedup import near_groups
from dyadics.llm.quality import quality_documents
from dyadics.llm.text_arrays import chunks, hashes


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def opposite(n):
    return thue_morse(n, "b", "a")


def test_thue_morse_words_differ_up_to_2_16_bytes(spark):
    rows, k = [], 0
    for p in range(3, 17):
        rows += [(k, thue_morse(1 << p)), (k + 1, opposite(1 << p))]
        k += 2
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    lines = [(0, "\n".join(t for _, t in rows)), (1, "\n".join(t for _, t in rows) + "\n" + rows[-1][1])]
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality_documents(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1}


def test_runs_of_all_lengths_hash_by_their_bytes_alone():
    draw = np.random.default_rng(1)
    runs = [bytes(draw.integers(0, 3, n, dtype=np.uint8)) for n in list(range(1, 200)) * 3] + [b"\0" * n for n in range(0, 40)]
    runs += [b"x" * 7 + r for r in runs[:50]]
    text = b"|".join(runs)
    starts = np.cumsum([0] + [len(r) + 1 for r in runs[:-1]])
    ends = starts + np.array([len(r) for r in runs])
    value = hashes(np.frombuffer(text, np.uint8), starts, ends)
    for a, b in zip(runs, value, strict=True):  # alone at the end of the data as within it
        assert hashes(np.frombuffer(a, np.uint8), np.array([0]), np.array([len(a)]))[0] == b
    assert len(set(value.tolist())) == len(set(runs))


def test_no_data():
    empty = np.zeros(0, np.int64)
    assert len(hashes(np.zeros(0, np.uint8), empty, empty)) == 0
    assert [len(x[1]) for x in chunks(pa.RecordBatch.from_arrays([pa.array([None, ""])], names=["text"]))] == [0]
