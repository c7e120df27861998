"""Closed records: exact members, each of a given form, checked as Column expressions.

``valid(name, column)`` judges strict JSON text against the record of that name.  A form is
a short text: ``u`` (decimal string up to 2**63 - 1), ``u1`` (the same from 1), ``hash``,
``bool``, ``text``, ``pub``, ``sig``, ``id:prefix``, ``int:low:high``, ``is:value`` (string),
``one:A|B``, ``profile``, ``endpoint`` or ``@record``; ``?`` before it admits null, ``[n `` an
array of at most n, ``<n `` one that is sorted without repeats as well.

Defined cases: null, text that is no JSON object, surplus or missing members and members
of another type are invalid; member order and white space don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of the records and their forms.
RECORDS: dict[str, dict[str, str]] = {
    "head": {"seq": "u", "hash": "hash"},
    "pin": {"key_id": "id:wky", "public_key": "pub"},
    "principal": {"id": "id:wpr", "pin": "@pin", "roles": "<4 one:operator|producer|reader|watcher"},
    "native": {"profile": "profile", "native_ref": "text", "native_artifact": "hash", "verification": "one:VERIFIED_AT_PIN|ASSERTED"},
    "spend": {"kind": "is:spend", "subject": "id:wsu", "delta": "u", "unit": "is:usd_micro", "usage_id": "text"},
    "scope": {"kind": "is:scope", "subject": "id:wsu", "policy_hash": "?hash", "scope_hash": "?hash", "reported_violation": "bool"},
    "replication": {"kind": "is:replication", "subject": "id:wsu", "processes": "?u", "threads": "?u", "declared_processes": "?u"},
    "pulse": {"kind": "is:pulse"},
    "terminal": {"kind": "is:terminal"},
    "coverage": {"kind": "is:coverage", "complete": "bool"},
    "signal": {"kind": "is:signal", "subject": "id:wsu", "artifact": "hash"},
    "source_body": {"v": "int:1:1", "fleet": "id:wfl", "source": "id:wso", "seq": "u1", "prev": "hash", "observed_ms": "u", "native": "@native", "observation": "@observation", "key_id": "id:wky"},
    "source_entry": {"body": "@source_body", "hash": "hash", "sig": "sig"},
    "accepted": {"index": "u", "received_ms": "u", "entry": "@source_entry", "late": "bool", "counted": "bool"},
    "source_view": {"source": "id:wso", "state": "one:EMPTY|ACTIVE|GAPPED|FORKED|TERMINAL|RETIRED", "head": "@head", "last_received_ms": "?u", "complete": "bool", "pending": "int:0:256"},
    "source_config": {"id": "id:wso", "principal": "id:wpr", "pin": "@pin", "profile": "profile", "subjects": "<512 id:wsu", "meter": "bool", "enabled": "bool"},
    "subject_config": {"id": "id:wsu", "policies": "<32 hash", "scopes": "<32 hash", "max_processes": "u1", "max_threads": "u1"},
    "watcher_config": {"id": "id:wwa", "principal": "id:wpr", "pin": "@pin", "domain": "id:wdo", "enabled": "bool"},
    "source_cut": {"source": "id:wso", "head": "@head", "state": "one:EMPTY|ACTIVE|GAPPED|FORKED|TERMINAL|RETIRED", "activated_ms": "u", "last_received_ms": "?u", "last_input": "?hash", "complete": "bool"},
    "manifest": {
        "v": "int:1:1", "fleet": "id:wfl", "config": "hash", "start_ms": "u", "end_ms": "u", "through_index": "u", "inputs": "[4096 hash", "history": "[5 hash", "cuts": "[64 @source_cut",
        "quality": "one:COMPLETE|INCOMPLETE|DEGRADED",
    },
    "decision": {"status": "one:HIT|CLEAR|UNKNOWN|SIGNAL", "reason": "code", "value": "?u", "limit": "?u"},
    "result_body": {
        "v": "int:1:1", "fleet": "id:wfl", "config": "hash", "manifest": "hash", "detector": "one:replication_anomaly/1|scope_drift/1|spend_spike/1|stream_silence/1", "target": "text", "decision": "@decision",
        "evidence": "<4096 hash",
    },
    "result": {"body": "@result_body", "hash": "hash"},
    "vote_body": {"v": "int:1:1", "fleet": "id:wfl", "watcher": "id:wwa", "config": "hash", "result": "hash", "manifest": "hash", "key_id": "id:wky"},
    "vote": {"body": "@vote_body", "hash": "hash", "sig": "sig"},
    "alert_view": {
        "id": "id:wal", "result": "hash", "state": "one:ACKNOWLEDGED|CANDIDATE|CLOSED|CORROBORATED|EXPIRED", "assurance": "one:VALID|DEGRADED", "domains": "<16 id:wdo", "votes": "<16 hash", "expires_ms": "u",
        "delivery": "one:NONE|QUEUED|IN_FLIGHT|RETRY|DELIVERED|FAILED|CANCELLED", "revision": "u",
    },
    "subscription": {"id": "id:wss", "watcher": "id:wwa", "state": "one:ACTIVE|PAUSED|EXPIRED|CLOSED", "ack": "u", "delivered": "u", "lease_until_ms": "u", "revision": "u"},
    "page_body": {"v": "int:1:1", "fleet": "id:wfl", "alert": "id:wal", "result": "hash", "config": "hash", "manifest": "hash", "corroborated": "@head", "semantics": "text", "key_id": "id:wky"},
    "page": {"body": "@page_body", "hash": "hash", "sig": "sig"},
    "delivery": {"alert": "id:wal", "state": "one:NONE|QUEUED|IN_FLIGHT|RETRY|DELIVERED|FAILED|CANCELLED", "attempts": "int:0:8", "due_ms": "?u", "lease_until_ms": "?u", "last_status": "?int:100:599"},
    "checkpoint_body": {"v": "int:1:1", "fleet": "id:wfl", "head": "@head", "through_index": "u", "logical_ms": "u", "config": "?hash", "key_id": "id:wky"},
    "checkpoint": {"body": "@checkpoint_body", "hash": "hash", "sig": "sig"},
    # data of journal rows, by kind
    "Tick": {"logical_ms": "u"},
    "ConfigActivated": {"config": "hash"},
    "KeysRevoked": {"config": "hash", "keys": "<256 id:wky"},
    "SourceAccepted": {"accepted": "@accepted"},
    "SourceBuffered": {"entry": "@source_entry"},
    "SourceForkObserved": {"source": "id:wso", "left": "@source_entry", "right": "@source_entry", "reason": "one:SLOT_FORK|TERMINAL_SUFFIX"},
    "WindowFinalized": {"manifest": "hash", "result_count": "int:1:1089"},
    "ResultFinalized": {"result": "hash"},
    "AlertCreated": {"alert": "@alert_view"},
    "VoteAccepted": {"alert": "id:wal", "vote": "@vote"},
    "AlertChanged": {
        "alert": "id:wal", "from": "one:ACKNOWLEDGED|CANDIDATE|CLOSED|CORROBORATED|EXPIRED", "to": "one:ACKNOWLEDGED|CANDIDATE|CLOSED|CORROBORATED|EXPIRED", "actor": "?id:wpr", "note_hash": "?hash", "revision": "u",
    },
    "AlertDegraded": {"alert": "id:wal", "source": "?id:wso", "key": "?id:wky", "revision": "u"},
    "SubscriptionChanged": {"subscription": "@subscription", "event": "one:OPEN|PAUSE|RESUME|EXPIRE|CLOSE"},
    "DeliveryChanged": {"delivery": "@delivery", "page": "?hash", "cancel_pending": "bool"},
    "FleetChanged": {"from": "one:RUNNING|READ_ONLY|LOCKED", "to": "one:RUNNING|READ_ONLY|LOCKED", "reason": "one:CAPACITY|OPERATOR"},
    # parameters of methods
    "fleet.get": {},
    "source.append": {"entries": "[64 @source_entry"},
    "subscription.open": {"watcher": "id:wwa", "after_seq": "u"},
    "subscription.read": {"subscription": "id:wss", "after_seq": "u", "limit": "int:1:128"},
    "subscription.ack": {"subscription": "id:wss", "through_seq": "u"},
    "subscription.set": {"subscription": "id:wss", "action": "one:pause|resume|close", "expected_revision": "u"},
    "vote.submit": {"vote": "@vote"},
    "alert.list": {"state": "?one:ACKNOWLEDGED|CANDIDATE|CLOSED|CORROBORATED|EXPIRED", "after": "?id:wal", "limit": "int:1:128"},
    "alert.get": {"alert": "id:wal"},
    "alert.act": {"alert": "id:wal", "action": "one:ack|close", "expected_revision": "u", "note_hash": "?hash"},
    "audit.read": {"after_seq": "u", "through": "?@head", "limit": "int:1:128"},
    "bundle.export": {"after_seq": "u", "checkpoint": "@checkpoint", "limit": "int:1:128"},
    "client_config": {"v": "int:1:1", "endpoint": "endpoint", "fleet": "id:wfl", "principal_key_file": "text", "trust_file": "text", "timeout_ms": "int:100:60000"},
}
#: Records that take one of several shapes, told by the member ``kind``.
SHAPES = {"observation": ("spend", "scope", "replication", "pulse", "terminal", "coverage", "signal")}
#: String forms.
FORMS = {
    "u": r"\A(0|[1-9][0-9]{0,18})\z", "hash": r"\A[0-9a-f]{64}\z", "pub": r"\A[A-Za-z0-9_-]{42}[AEIMQUYcgkosw048]\z", "sig": r"\A[A-Za-z0-9_-]{85}[AQgw]\z", "code": r"\A[A-Z][A-Z_]{0,63}\z",
    "profile": r"\A[a-z]+(-[a-z]+)*/[0-9]+\z", "endpoint": r"\Ahttps?://[^/?#\s]+(/[^\s]*)?\z",
}


def _string(v: Column, pattern: str) -> Column:
    return (F.schema_of_variant(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(pattern)


def form(v: Column, kind: str) -> Column:
    """Whether a variant has the form; null counts as no."""
    if kind.startswith("?"):
        return F.is_variant_null(v) | form(v, kind[1:])
    if kind[0] in "[<":
        most, each = kind[1:].split(" ", 1)
        items = F.try_variant_get(v, "$", "array<variant>")
        fits = items.isNotNull() & (F.size(items) <= int(most)) & F.forall(items, lambda x: F.coalesce(form(x, each), F.lit(False)))
        if kind[0] == "<":
            texts = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
            fits = fits & (texts == F.array_sort(F.array_distinct(texts)))
        return fits
    name, _, rest = kind.partition(":")
    if name.startswith("@"):
        return record(v, name[1:])
    if name == "bool":
        return F.schema_of_variant(v) == "BOOLEAN"
    if name == "int":
        low, high = map(int, rest.split(":"))
        return (F.schema_of_variant(v) == "BIGINT") & F.try_variant_get(v, "$", "bigint").between(low, high)
    text = F.try_variant_get(v, "$", "string")
    if name == "id":
        return _string(v, rf"\A{rest}_[A-Za-z0-9_-]{{21}}\z")
    if name in ("is", "one"):
        return (F.schema_of_variant(v) == "STRING") & text.isin(rest.split("|"))
    if name == "text":
        return (F.schema_of_variant(v) == "STRING") & F.char_length(text).between(1, 256) & (F.octet_length(text) <= 1024) & ~text.rlike(r"[\x00-\x1f\x7f]")
    if name in ("u", "u1"):
        return _string(v, FORMS["u"]) & text.try_cast("bigint").isNotNull() & ((text != "0") if name == "u1" else F.lit(True))
    return _string(v, FORMS[name])


def record(v: Column, name: str) -> Column:
    """Whether a variant is the record of that name, with no other members."""
    if name in SHAPES:
        kind = F.try_variant_get(v, "$.kind", "string")
        shape = F.lit(False)
        for s in SHAPES[name]:
            shape = F.when(kind == s, record(v, s)).otherwise(shape)
        return shape
    members = RECORDS[name]
    fits = F.json_object_keys(F.to_json(v)) == F.array(*[F.lit(k) for k in sorted(members)]).cast("array<string>")  # a variant's members are sorted
    for k, kind in members.items():
        fits = fits & F.coalesce(form(F.try_variant_get(v, f"$.{k}", "variant"), kind), F.lit(False))
    return F.coalesce(fits, F.lit(False))


def valid(name: str, text: Column) -> Column:
    """Whether JSON text is the record of that name."""
    return record(F.try_parse_json(text), name)


def same(left: Column, right: Column) -> Column:
    """Whether two JSON texts mean the same: members in any order, strings as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(left)) == F.to_json(F.try_parse_json(right)), F.lit(False))
