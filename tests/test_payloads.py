import base64
import json
from datetime import datetime

from millrace.sources import payloads as Y

b64 = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")


def frame(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")


def test_mail_parts_headers_and_labels(spark):
    plain = {"id": "m1", "threadId": "t", "labelIds": ["INBOX", "UNREAD"], "internalDate": "1715781600000", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "From", "value": "Kim <Kim@X.org>"}, {"name": "To", "value": "a@b.com, C@d.com"}, {"name": "Subject", "value": "Hi"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": b64("hällo?>")}}, {"mimeType": "text/html", "body": {"data": b64("<b>x</b>")}}]}, {"mimeType": "application/pdf", "filename": "a.pdf", "body": {"attachmentId": "1", "size": 3}}]}}
    html = {"id": "m2", "threadId": "t", "internalDate": "x", "payload": {"mimeType": "text/html", "headers": [], "body": {"data": b64("<i>only</i>")}}}
    one, two = sorted(Y.mail(frame(spark, plain, html)).collect(), key=lambda r: r.message_id)
    assert (one.body, one.from_email, one.to_emails, one.subject, one.has_attachments, one.is_unread) == ("hällo?>", "kim@x.org", ["a@b.com", "c@d.com"], "Hi", True, True)
    assert one.sent_at == datetime(2024, 5, 15, 14, 0)
    assert (two.body.strip(), two.from_email, two.has_attachments, two.sent_at) == ("only", None, False, None)


def test_events_of_days_zones_and_stubs(spark):
    rows = [
        {"id": "a", "status": "confirmed", "summary": "S", "start": {"dateTime": "2024-05-15T10:00:00+02:00"}, "end": {"dateTime": "2024-05-15T11:00:00+02:00"}, "attendees": [{"email": "K@x.org"}]},
        {"id": "b", "start": {"date": "2024-05-15", "timeZone": "America/New_York"}, "end": {"date": "2024-05-16"}},
        {"id": "c", "status": "confirmed"},
    ]
    a, b, c = sorted(Y.events(frame(spark, *rows)).collect(), key=lambda r: r.event_id)
    assert a.starts_at == datetime(2024, 5, 15, 8) and a.attendee_emails == ["k@x.org"] and not a.all_day
    assert b.all_day and b.starts_at == datetime(2024, 5, 15, 4) and c.status == "cancelled" and c.starts_at is None


def test_files_and_history(spark):
    f = Y.drive(frame(spark, {"id": "f", "name": "n", "size": "12", "owners": [{"emailAddress": "O@x.org"}], "parents": ["p"], "trashed": True})).first()
    assert (f.size_bytes, f.owner_email, f.folder_id, f.deleted, f.is_shared) == (12, "o@x.org", "p", True, False)
    page = {"history": [{"id": "5", "messagesAdded": [{"message": {"id": "x"}}], "labelsAdded": [{"message": {"id": "y"}}]}, {"id": "6", "messagesDeleted": [{"message": {"id": "x"}}]}]}
    assert sorted((r.message_id, r.seq, r.deleted) for r in Y.history(frame(spark, page)).collect()) == [("x", 6, True), ("y", 5, False)]


def test_lines_and_aliases(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"_schema": "1"}\n{"id": 3, "q": "x"}\n')
    assert [tuple(r) for r in Y.jsonl(spark, str(tmp_path / "d.jsonl"), "id int, q string").collect()] == [(3, "x")]
    assert Y.alias_table({"sky": {"token": ["SkyAir"], "domain": ["sky.example"]}}, spark).count() == 2


def test_alias_files_become_an_alias_table(spark, tmp_path):
    from millrace.operators.evidence import terms_of
    from millrace.sources.payloads import alias_files

    lines = ['{"group": "blue", "tokens": ["Blue Air"], "domains": ["blueair.com"]}', '{"group": "blue", "tokens": ["BA", "Blue Air"], "codes": ["BX-\\\\d+"]}', '{"group": "red"}', '{"tokens": ["lost"]}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    table = alias_files(spark, str(tmp_path))
    assert {r.group: (r.tokens, r.domains, r.codes) for r in table.collect()} == {"blue": (["BA", "Blue Air"], ["blueair.com"], ["BX-\\d+"]), "red": ([], [], [])}
    assert terms_of("mail of blue air", table).aliases == ("BA", "Blue Air")


def test_mail_at_ingest(spark):
    from pyspark.sql import functions as F

    from millrace.functions.text import ingested_mail

    body = "Hello there,\r\nplease see the plan.  \n\n\n\nIt is long enough to stand in front of what a machine has added below it.\nReally."
    cases = {
        f"{body}\nOn Mon, Kim wrote:\n> x": True, f"{body}\n--\nKim": True, f"{body}\nTo unsubscribe click here\nmore": True, f"{body}\n> quoted\n": True, f"{body}\nSent from my iPhone": True,
        f"{body} https://t.example.com/track/77": True, f"unsubscribe me\n{body}": False, f"{body}\nsent from my desk": False,
    }
    want = "Hello there,\nplease see the plan.\n\nIt is long enough to stand in front of what a machine has added below it.\nReally."
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ingested_mail(F.col("t")).alias("m")).collect()
    assert {r.t: r.m == want for r in rows} == cases
    odd = spark.createDataFrame([(None,), ("",), ("word " * 9000,)], "t string").select(ingested_mail(F.col("t")).alias("m")).collect()
    assert [r.m for r in odd[:2]] == ["", ""] and len(odd[2].m) <= 40_004 and odd[2].m.endswith("word ...")
