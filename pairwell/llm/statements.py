"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

#: Five hexadecimal digits of the digest make four letters of base 32.
LETTERS = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::int >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0)
)

STATEMENTS: dict[str, str] = {
    "op8_warc": f"""
with p as (select page_id, coalesce(html, '') as body from pages),
     d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h, max(page_id) over (partition by body) as best from p)
select page_id, payload_bytes, {LETTERS} as payload_digest,
       case when page_id is distinct from best then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from best then best end as refers_to
from d
""",
}
