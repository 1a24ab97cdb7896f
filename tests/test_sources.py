"""JSON event and request sources on hand-written documents."""

import json
import tempfile

import pytest

from affinity import session
from affinity.operators import candidates as cd
from affinity.operators import entities as en
from affinity.operators import events as ev
from affinity.plans import model as md
from affinity.plans import scoring as sc
from affinity.sources import events as src
from tests.helpers import requests

EVENTS = [
    {"event": "$set", "entityType": "constraint", "entityId": "unavailableItems",
     "properties": {"items": ["jar of balm", "old soap"]}, "eventTime": "2031-05-04T08:00:00.250Z"},
    {"event": "$set", "entityType": "constraint", "entityId": "unavailableItems",
     "properties": {"items": ["mask 7"]}, "eventTime": "2031-05-05T08:00:00.250Z"},
    {"event": "$set", "entityType": "cosmetic", "entityId": "rose cream",
     "properties": {"categories": ["face", "night"], "brand": "Mill"}, "eventTime": "2031-05-04T08:00:00.250Z"},
    {"event": "$set", "entityType": "content", "entityId": "clip 12",
     "properties": {"cosmetics": ["rose cream", "rose cream"], "upload_date": "2031-04-01"}, "eventTime": "2031-05-04T08:00:00Z"},
    {"event": "rate", "entityType": "user", "entityId": "ana", "targetEntityType": "cosmetic",
     "targetEntityId": "rose cream", "properties": {"rating": 4.5}, "eventTime": "2031-05-06T09:30:00.000Z", "eventId": "e-one"},
    {"event": "view", "entityType": "user", "entityId": "ana", "targetEntityType": "content",
     "targetEntityId": "clip 12", "eventTime": "2031-05-06T09:31:00Z", "eventId": "17"},
]


def _write(lines):
    d = tempfile.mkdtemp(prefix="affinity-json-", dir="/tmp")
    with open(f"{d}/part-0.json", "w") as fh:
        for e in lines:
            fh.write(json.dumps(e) + "\n")
    return d


def test_event_json_source(spark):
    log, props = src.normalize(src.read_events_json(spark, _write(EVENTS)))
    rows = {r.event: r for r in log.collect()}
    assert rows["rate"].rating == 4.5 and rows["rate"].item_id == "rose cream" and rows["rate"].target_type == "cosmetic"
    assert rows["view"].event_id == 17
    assert [r.item_id for r in ev.unavailable_items(props).collect()] == ["mask 7"]
    its = {r.item_id: r for r in en.items_from_properties(props).collect()}
    assert its["rose cream"].categories == ["face", "night"] and its["rose cream"].brand == "Mill"
    assert its["clip 12"].cosmetics == ["rose cream"] and its["clip 12"].upload_date == "2031-04-01"


def _event(user, item, kind="view", entity="user", **more):
    return {"event": kind, "entityType": entity, "entityId": user, "targetEntityType": "cosmetic", "targetEntityId": item,
            "eventTime": "2031-05-06T09:30:00Z", **more}


def test_events_without_ids_have_ids_of_their_own(spark):
    log, _ = src.normalize(src.read_events_json(spark, _write([_event("ana", f"i {n}") for n in range(5)])))
    assert len({r.event_id for r in log.collect()}) == 5


def test_events_of_other_entities_are_no_interactions(spark):
    log, _ = src.normalize(src.read_events_json(spark, _write([_event("ana", "a"), _event("bot", "b", entity="robot")])))
    assert [r.user_id for r in log.collect()] == ["ana"]


def test_rate_event_without_a_rating(spark):
    lines = [_event("ana", "a", "rate", properties={"rating": 3}), _event("ben", "a", "rate"), _event("cid", "a", "rate", properties={"rating": "x"})]
    raw = src.read_events_json(spark, _write(lines))
    with pytest.raises(Exception, match="without a rating"):
        src.normalize(raw)[0].collect()
    assert [(r.user_id, r.rating) for r in src.normalize(raw, missing_rating="drop")[0].collect()] == [("ana", 3.0)]


def test_request_json_source(spark):
    reqs = [{"user": "ana", "num": 4, "item_type": "cosmetic", "categories": ["face"], "whiteList": ["rose cream"]},
            {"request_id": "r2", "user": "ben", "num": 2, "item_type": "content", "search": "red"}]
    got = {r.user_id: r for r in src.read_requests_json(spark, _write(reqs)).collect()}
    assert got["ana"].white_list == ["rose cream"] and got["ana"].categories == ["face"] and got["ana"].request_id
    assert got["ben"].request_id == "r2" and got["ben"].search == "red" and got["ben"].white_list is None


def test_equal_requests_without_ids_stay_apart(spark):
    r = src.read_requests_json(spark, _write([{"user": "ana", "num": 3, "item_type": "cosmetic"}] * 4))
    ids = [x.request_id for x in r.collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(x.request_id for x in r.collect())


def test_repeated_request_ids_are_refused(spark):
    reqs = requests(spark, [{"request_id": "r", "user_id": "ana", "num": 1, "item_type": "cosmetic"}] * 2)
    with pytest.raises(ValueError, match="unique"):
        sc.request_batch(cd.prepare_requests(reqs), cd.request_black_rows(reqs))


def test_read_training_folds_entities_and_guards_ids(spark):
    lines = EVENTS + [{"event": "$set", "entityType": "user", "entityId": "ana", "eventTime": "2031-05-01T00:00:00Z"}]
    data = md.read_training(*src.normalize(src.read_events_json(spark, _write(lines))))
    assert [r.user_id for r in data.users.collect()] == ["ana"]
    assert {r.item_id for r in data.items.collect()} == {"rose cream", "clip 12"}
    assert md.valid_training_log(data).count() == 2
    twice = EVENTS + [{"event": "$set", "entityType": "content", "entityId": "rose cream", "eventTime": "2031-05-01T00:00:00Z"}]
    with pytest.raises(ValueError, match="unique"):
        md.read_training(*src.normalize(src.read_events_json(spark, _write(twice))))


def test_checkpoint_folder_must_be_shared_off_a_local_master():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(Session())
