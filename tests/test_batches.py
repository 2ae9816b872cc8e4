"""Arrow batches are cut by bytes before they become Python objects."""

import pyarrow as pa

from tonelake.batches import pieces, records, table


def test_pieces_are_bounded_and_whole():
    sizes = [0, 5, 3000, 1, 0, 200, 200, 200, 9000, 2]
    batch = pa.RecordBatch.from_pydict({"i": range(len(sizes)), "x": [list(range(n)) for n in sizes]})
    cut = list(pieces(iter([batch, batch]), 4096))
    assert [i for b in cut for i in b.column(0).to_pylist()] == 2 * list(range(len(sizes)))
    assert all(len(b) == 1 or b.nbytes <= 4096 for b in cut) and len(cut) > 6
    assert [r["x"] for part in records(iter([batch]), 4096) for r in part] == [list(range(n)) for n in sizes]
    assert table([], batch.schema).num_rows == 0


def test_export_does_not_make_objects_of_a_whole_batch(spark):
    """6,000 scores of 100 notes in one Arrow batch: the worker that writes them stays small."""
    from tonelake.sinks import files

    notes = spark.range(6000 * 100, numPartitions=1).selectExpr("id div 100 AS score_id", "id % 2 AS track_ord", "id % 100 AS note_ord", "40 + id % 45 AS pitch", "240 * (id % 100) AS start_tick", "480L AS duration")
    points = spark.range(6000, numPartitions=1).selectExpr("id AS score_id", "0 AS ord", "0L AS tick", "4 AS numerator", "4 AS denominator", "0 AS fifths", "'major' AS mode", "120D AS bpm")
    rows = files.assembled(notes, points, points, points).coalesce(1)

    def resident(score):
        with open("/proc/self/statm") as f:
            return f"{int(f.read().split()[1]) * 4096 >> 20} {sum(len(t.notes) for t in score.tracks)}".encode()

    got = [bytes(r["content"]).decode().split() for r in files.export(rows, resident).collect()]
    assert len(got) == 6000 and all(n == "100" for _, n in got)
    assert max(int(mb) for mb, _ in got) < 400
