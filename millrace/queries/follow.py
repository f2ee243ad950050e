"""Follow-up joins over messages, calendar and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import follow
from ..sources.shapes import calendar, files, messages
from .base import query

# Six hours of one day; the account of a thread is one of fifty, as accounts of calendars are.
_FROM, _UPTO = 1_705_305_600_000_000, 1_705_327_200_000_000

_EDGES = """ed AS (SELECT 'event' AS fk, event_id::VARCHAR AS src, 'person' AS tk, unnest(list_append(list_transform(attendee_emails, lambda x: lower(x)), organizer_email)) AS dst FROM calendar
UNION ALL SELECT 'person', 'u' || (thread_id % 50) || '@example.com', 'thread', thread_id::VARCHAR FROM messages WHERE position = 0
UNION ALL SELECT 'thread', thread_id::VARCHAR, 'message', message_id FROM messages WHERE position <= 1
UNION ALL SELECT 'message', message_id, 'file', file_id::VARCHAR FROM messages JOIN files ON thread_id = file_id WHERE has_attachments)"""


def _edges(spark: SparkSession, d: str) -> list[follow.Edge]:
    e, m, f = calendar(spark, d), messages(spark, d), files(spark, d)
    text = lambda c: F.col(c).cast("string")
    people = F.explode(F.concat(F.transform("attendee_emails", F.lower), F.array("organizer_email")))
    account = F.concat(F.lit("u"), F.pmod("thread_id", F.lit(50)), F.lit("@example.com"))
    return [
        follow.Edge("event", "person", e.select(text("event_id").alias("src"), people.alias("dst"))),
        follow.Edge("person", "thread", m.where("position = 0").select(account.alias("src"), text("thread_id").alias("dst"))),
        follow.Edge("thread", "message", m.where("position <= 1").select(text("thread_id").alias("src"), F.col("message_id").alias("dst"))),
        follow.Edge("message", "file", m.where("has_attachments").join(f.select("file_id"), F.col("thread_id") == F.col("file_id")).select(F.col("message_id").alias("src"), text("file_id").alias("dst"))),
    ]


@query(f"""WITH RECURSIVE {_EDGES}, r(kind, id, hop, path) AS (SELECT 'event', event_id::VARCHAR, 0, 'event:' || event_id FROM calendar WHERE starts_us >= {_FROM} AND starts_us < {_UPTO}
UNION SELECT tk, dst, hop + 1, path || ' ' || tk || ':' || dst FROM r JOIN ed ON fk = kind AND src = id WHERE hop < 4)
SELECT kind, id, min(hop)::INT AS hop, min(path) AS path FROM r GROUP BY kind, id""")
def j14_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Everybody at the events of a window, their threads, the first messages of these, and the files that belong to them."""
    window = calendar(spark, d).where((F.col("starts_us") >= F.lit(_FROM)) & (F.col("starts_us") < F.lit(_UPTO)))
    return follow.expand(window.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id")), _edges(spark, d), 4)


_WAVE = """mh AS (SELECT message_id, row_number() OVER (ORDER BY length(body) DESC, message_id) AS rank, length(body) % 2 = 0 AS ok FROM messages ORDER BY length(body) DESC, message_id LIMIT 40),
eh AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank, title = 'signup' AS ok FROM calendar ORDER BY value DESC, event_id LIMIT 40),
be AS (SELECT c.event_id, list_distinct(list_prepend(organizer_email, list_transform(attendee_emails, lambda x: lower(x)))) AS people, title, organizer_email, attendee_emails FROM calendar c JOIN (SELECT event_id FROM eh WHERE ok ORDER BY rank LIMIT 1) USING (event_id)),
pp AS (SELECT event_id, lower(organizer_email) AS p, 0 AS k FROM be UNION ALL SELECT event_id, lower(unnest(attendee_emails)), unnest(range(1, len(attendee_emails) + 1)) FROM be),
pq AS (SELECT event_id, p, min(k) AS k FROM pp GROUP BY event_id, p),
two AS (SELECT m.thread_id, min_by(m.position, rank) AS anchor FROM (SELECT * FROM mh WHERE ok ORDER BY rank LIMIT 2) h JOIN messages m USING (message_id) GROUP BY m.thread_id)"""


@query(f"""WITH {_WAVE} SELECT 'participant' AS part, event_id::VARCHAR AS of_, p AS ref, (row_number() OVER (ORDER BY k) - 1)::INT AS place FROM pq
UNION ALL SELECT 'thread', thread_id::VARCHAR, message_id, position::INT FROM messages JOIN two USING (thread_id)
UNION ALL SELECT 'reply', thread_id::VARCHAR, message_id, position::INT FROM messages JOIN two USING (thread_id) WHERE position > anchor
UNION ALL SELECT * FROM (SELECT 'file', event_id::VARCHAR, file_id::VARCHAR, (row_number() OVER (ORDER BY file_id) - 1)::INT FROM files, be WHERE contains(' ' || regexp_replace(lower(name || ' ' || folder_path), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || title || ' ') ORDER BY file_id LIMIT 3)""")
def r20_second_wave(spark: SparkSession, d: str) -> DataFrame:
    """What follows the longest mails and the event of highest value."""
    m, e = messages(spark, d), calendar(spark, d)
    mails = m.select("message_id", (F.length("body") % 2 == 0).alias("ok"), F.struct(-F.length("body"), "message_id").alias("rank")).orderBy("rank").limit(40)
    events = e.select("event_id", (F.col("title") == "signup").alias("ok"), F.struct((-F.col("value")).alias("v"), "event_id").alias("rank")).orderBy("rank").limit(40)
    return follow.second_wave(spark, mails, events, m, e, files(spark, d)).withColumnRenamed("of", "of_")
