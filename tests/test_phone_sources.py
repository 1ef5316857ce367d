"""Private stores of messages, calls, visits and documents, from files made here."""

import json
import sqlite3

import pytest

from tidemark.sources import phone, readers


def database(path, script):
    with sqlite3.connect(path) as con:
        con.executescript(script)
    return f"file://{path}"


def test_text_messages(spark, tmp_path):
    path = database(tmp_path / "m.db", """
        create table message (text, date, is_from_me, is_spam, is_system_message, is_service_message, handle_id, associated_message_type);
        create table handle (id); create table chat (display_name, is_filtered); create table chat_message_join (chat_id, message_id);
        insert into handle values ('+15550001'), ('+15550002');
        insert into chat values ('Team', 0);
        insert into message values ('hi', 1000000000, 0, 0, 0, 0, 1, 0), ('all', 2000000000, 1, 0, 0, 0, 2, null), ('spam', 3, 0, 1, 0, 0, 1, 0), (null, 3000000000, 0, 0, 0, 0, 2, 2001), (null, 4, 0, 0, 0, 0, 2, 2006), ('sys', 5, 0, 0, 1, 0, 1, 0);
        insert into chat_message_join values (1, 2);""")
    got = {r["source_id"]: r for r in phone.text_messages(spark, path).collect()}
    assert set(got) == {"1", "2", "4"}
    assert (got["1"]["ts"], got["1"]["sender"], got["1"]["thread_id"], got["1"]["event_type"]) == (978307201, "+15550001", "imessage:+15550001", "message")
    assert got["2"]["is_from_me"] and got["2"]["sender"] is None and got["2"]["thread_id"] == "chat:1"
    assert got["4"]["reaction"] == "loved" and got["4"]["event_type"] == "reaction" and got["4"]["text"] is None


def test_chat_store(spark, tmp_path):
    path = database(tmp_path / "w.db", """
        create table ZWAMESSAGE (Z_PK, ZTEXT, ZMESSAGEDATE, ZISFROMME, ZMESSAGETYPE, ZFROMJID, ZCHATSESSION, ZGROUPMEMBER);
        create table ZWACHATSESSION (Z_PK, ZCONTACTJID, ZPARTNERNAME); create table ZWAGROUPMEMBER (Z_PK, ZMEMBERJID, ZCONTACTNAME, ZFIRSTNAME); create table ZWAPROFILEPUSHNAME (ZJID, ZPUSHNAME);
        insert into ZWACHATSESSION values (1, '1@s.whatsapp.net', 'Ann'), (2, '9@g.us', 'Group');
        insert into ZWAGROUPMEMBER values (7, '3@s.whatsapp.net', '', 'Cy'), (8, '1@s.whatsapp.net', 'Other', null);
        insert into ZWAPROFILEPUSHNAME values ('1@s.whatsapp.net', 'annie'), ('2@s.whatsapp.net', 'Bo');
        insert into ZWAMESSAGE values (1, 'a', 5.5, 0, 0, '1@s.whatsapp.net', 1, null), (2, 'b', 6, 0, 0, '9@g.us', 2, 7), (3, 'x', 7, 1, 10, null, 1, null), (4, 'like', 8, 1, 59, null, 1, null);""")
    got = {r["source_id"]: r for r in phone.chat_messages(spark, path).collect()}
    assert set(got) == {"1", "2", "4"} and got["2"]["sender"] == "3@s.whatsapp.net" and got["2"]["is_group"] and got["4"]["event_type"] == "reaction" and got["4"]["text"] is None and got["1"]["ts"] == 978307205
    assert dict(map(tuple, phone.chat_names(spark, path).collect())) == {"1@s.whatsapp.net": "Ann", "2@s.whatsapp.net": "Bo", "3@s.whatsapp.net": "Cy"}


@pytest.mark.parametrize("rows,expected", [([(c, "me") for c in range(3)] + [(0, "a"), (1, "a")], [("me", 3)]), ([(0, "me")], []), ([], [])])
def test_own_address(spark, rows, expected):
    assert list(map(tuple, phone.own_address(spark.createDataFrame(rows, "conversation long, address string")).collect())) == expected


def test_calls_and_visits(spark, tmp_path):
    path = database(tmp_path / "c.db", """create table ZCALLRECORD (Z_PK, ZDATE, ZDURATION, ZADDRESS, ZORIGINATED, ZANSWERED, ZCALLTYPE);
        insert into ZCALLRECORD values (1, 10, 60.26, '(555) 123-4567', 1, 0, 1), (2, 10, 3, '5551234567', 0, 1, 1), (3, 11, 30, ' ', 0, 1, 1), (4, 12, 90, 'ann@x.org', 0, 1, 8);""")
    got = sorted((r["ts"], r["seconds"], r["address"], r["originated"], r["answered"], r["call_type"]) for r in phone.calls(spark, path).collect())
    assert got == [(978307210, 60.3, "+15551234567", True, False, "voice"), (978307212, 90.0, "ann@x.org", False, True, "video")]
    path = database(tmp_path / "s.db", """create table history_visits (id, history_item, visit_time); create table history_items (id, url, domain_expansion); create table history_tags (history_item, tag);
        insert into history_items values (1, 'https://a.org/x', 'a'), (2, 'about:blank', null); insert into history_visits values (5, 1, 1.5), (6, 2, 2); insert into history_tags values (1, 'b'), (1, 'a');""")
    assert [(r["visit_id"], r["ts"], r["tags"]) for r in phone.tagged_visits(spark, path).collect()] == [(5, 978307201, ["a", "b"])]


def test_recipients_and_tables(spark, tmp_path):
    path = database(tmp_path / "e.db", """create table recipients (message, type, position, address); create table addresses (address);
        insert into addresses values ('a@x.org'), ('b@x.org'), (''); insert into recipients values (1, 0, 1, 2), (1, 0, 0, 1), (1, 1, 0, 2), (2, 2, 0, 1), (2, 0, 0, 3);""")
    got = {r["message"]: (r["to"], r["cc"], r["bcc"]) for r in phone.recipients(spark, path).collect()}
    assert got == {1: (["a@x.org", "b@x.org"], ["b@x.org"], []), 2: ([], [], ["a@x.org"])}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "no.db").write_bytes(b"nothing of the kind, but long enough to be looked at")
    assert [(r["missing"], r["optional"]) for r in phone.tables(spark, path, ["recipients", "messages"], ["addresses", "x"]).collect()] == [(["messages"], ["addresses"])]
    assert [r["missing"] for r in phone.tables(spark, f"file://{tmp_path}/bad/no.db", ["a"]).collect()] == [["a"]]


def test_documents_calendar_and_profile(spark, tmp_path):
    notes = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "Plan"}]}, {"type": "paragraph"}, {"type": "orderedList", "content": [{"content": [{"type": "paragraph", "content": [{"type": "text", "text": w}]}]} for w in ("one", "two")]}]}
    (tmp_path / "d.json").write_text(json.dumps({"id": "1", "title": "t", "created_at": 5, "people": ["a@x.org"], "notes": json.dumps(notes), "transcript": [{"speaker": "Ann", "text": "hi"}]}) + "\n" + json.dumps({"id": "2"}))
    got = {r["source_id"]: r for r in phone.meeting_documents(spark, f"file://{tmp_path}/d.json").collect()}
    assert got["1"]["text"] == "## Plan\n1. one\n2. two\nAnn: hi" and got["1"]["has_transcript"] and got["2"]["text"] == "" and not got["2"]["has_transcript"]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(x) for x in ({"key": "k", "start": 1, "end": 2, "title": "t", "notes": "n"}, {"key": "k", "start": 3, "status": "cancelled"})))
    assert [(r["ts"], r["body"]) for r in phone.calendar(spark, f"file://{tmp_path}/c.json").collect()] == [(1, "t\nn")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.yaml").write_text("name: 'Ann Lee'\nemails: [a@x.org, \"b@x.org\"]\nphones:\n  - 555\n  - '666'\n")
    (tmp_path / "p" / "b.json").write_text('{"user": {"name": "Bo", "emails": ["c@x.org"]}}')
    (tmp_path / "p" / "c.yaml").write_text("")
    assert sorted(map(tuple, phone.profile(spark, f"file://{tmp_path}/p").collect())) == [("Ann Lee", ["a@x.org", "b@x.org"], ["555", "666"]), ("Bo", ["c@x.org"], [])]


def test_no_reply_undo_and_positions(spark):
    df = spark.createDataFrame([("No-Reply@x.org",), ("ann@mail.lever.co",), ("ann@clever.co",), ("info@x.org",), (None,), ("lever.co",)], "a string")
    assert [r[0] for r in df.select(phone.no_reply(df["a"])).collect()] == [True, True, False, True, False, False]
    stack = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id long, created_at long")
    top, rest = phone.newest_undo(stack)
    assert [r["id"] for r in top.collect()] == [3] and sorted(r["id"] for r in rest.collect()) == [1, 2]
    table = spark.createDataFrame([("b", 0), ("a", 4)], "name string, position long")
    assert dict(map(tuple, phone.next_position(table, spark.createDataFrame([("d",), ("a",), ("c",)], "name string")).collect())) == {"b": 0, "a": 4, "c": 5, "d": 6}
    assert readers.get_reader("calls") is phone.calls
