import json

S1, S2 = "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"


def event(seq, session=S1, at="12:00:00", kind="CommandExecuted", version=1, **fields):
    base = {"schema_version": version, "seq": seq, "session_id": session, "ts": f"2026-05-27T{at}Z", "kind": kind}
    if kind == "CommandExecuted":
        base |= {"command_id": "Doc.Save", "args": {}, "duration_ms": 1, "outcome": "success"}
    return json.dumps(base | fields)


def opened(seq, screen="Editor", **more):
    return event(seq, kind="ScreenOpened", screen_id=screen, **more)


def log(tmp_path, lines, name="log.jsonl"):
    path = tmp_path / name
    path.write_bytes("\n".join(lines).encode() + b"\n")
    return str(path)


def two_sessions():
    return [
        opened(0, params={}), event(1, at="12:00:01", command_id="Doc.Recalculate"), event(2, at="12:00:02", kind="ExceptionThrown", exception_type="InvalidOperation", message="boom"),
        opened(0, session=S2, params={}), event(1, session=S2, at="12:00:01"),
    ]
