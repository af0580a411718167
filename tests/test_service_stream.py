"""A service as a stream: what it reads, and that it goes on behind the last batch."""

import json

from sieveline.sources import service_stream as R

from . import fake_service


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    R.register(spark)
    state, out = tmp_path / "last", f"{tmp_path}/out"

    def run(last, down):
        state.write_text(f"{last} {down}")
        feed = spark.readStream.format("paged_service").option("fetch", "tests.fake_service:fetch").option("argument", str(state)).option("page", "20").option("empty", "15").load()
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["message_id"], r["error"]) for r in spark.read.parquet(out).collect())

    alive = lambda last, down=0: [(i, "down" if i == down else None) for i in range(1, last + 1) if i % 10 or i == down]
    assert run(97, 33) == alive(97, 33)
    more = run(135, 0)
    assert more == [*alive(97, 33), *[(i, None) for i in range(98, 136) if i % 10]]  # what failed is told once, and what was read is not read again
    assert run(135, 0) == more
    read = [json.loads(r["payload"])["message_id"] for r in spark.read.parquet(out).filter("payload is not null").collect()]
    assert len(read) == len(set(read)) == len(more) - 1


def test_last_ids(tmp_path):
    state = tmp_path / "last"
    for last in (0, 1, 2, 9, 31, 64, 999):
        state.write_text(f"{last} -1")
        reader = R.ServiceReader({"fetch": "tests.fake_service:fetch", "argument": str(state), "empty": "12", "page": "100"})
        assert reader.latestOffset() == {"id": last - (last > 0 and last % 10 == 0)}
        assert [(p.first, p.last) for p in reader.partitions({"id": 5}, {"id": 230})] == [(6, 105), (106, 205), (206, 230)]
    assert reader.partitions({"id": 7}, {"id": 7}) == [] and fake_service.fetch(10, str(state)) is None
