"""Messages go out at least once and stand in the ledger once."""

from pyspark.sql import functions as F

from tidewell.operators.outbox import Outbox

SCHEMA = "member_id long, opportunity_id long"


def test_claims_sending_and_takeover(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), SCHEMA, "member_id", parcels=3)
    rows = spark.range(200).selectExpr("id % 20 AS member_id", "id AS opportunity_id")
    box.put("digest 1", rows.union(rows.limit(10)))
    box.put("digest 1", rows)  # before anything is claimed a batch may come again
    folder = tmp_path / "mails"
    folder.mkdir()
    at = str(folder)

    def deliver(message):
        import pathlib
        import uuid

        (pathlib.Path(at) / f"{message['key']}.{uuid.uuid4().hex}").touch()

    assert len(box.open()) == 3 and box.ledger().count() == 0
    lost = box.claim("a", now=0, lease=10)
    n = box.send(lost, deliver)  # and then the worker is lost
    assert n == box.messages(lost).count() > 0
    second, third = box.claim("b", 1, 10), box.claim("b", 1, 10)
    assert len({lost.parcel, second.parcel, third.parcel}) == 3 and box.claim("c", 5, 10) is None
    box.put("digest 1", rows.limit(1))  # too late to change it
    for claim in (second, third):
        box.send(claim, deliver)
        assert box.confirm(claim) and not box.confirm(claim)
    again = box.claim("c", 11, 10)
    assert again.parcel == lost.parcel and again.version == 2
    assert not box.confirm(lost)  # taken over
    box.send(again, deliver)
    assert box.confirm(again) and box.open() == [] and box.claim("d", 99, 1) is None
    sent = box.ledger()
    assert sorted((r.member_id, r.opportunity_id) for r in sent.collect()) == sorted((i % 20, i) for i in range(200))
    went = [x.name.partition(".")[0] for x in folder.iterdir()]
    assert set(went) == {r.key for r in sent.select("key").collect()} and len(went) == 200 + n
    assert sent.groupBy("key").count().where("count > 1").count() == 0
    assert sent.where(F.col("member_id").isNull()).count() == 0
