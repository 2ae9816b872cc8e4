"""Project files: a versioned JSON envelope around a score."""

from __future__ import annotations

import json

from .score import FormatError, Note, Score, Track

FORMAT, VERSION = "tonelake", 1
#: Envelopes of other programs with the same layout can be named here.
FORMATS = {FORMAT}


def write_project(score: Score, name: str | None = None, saved_at: str | None = None) -> str:
    return json.dumps({"format": FORMAT, "version": VERSION, "name": name, "savedAt": saved_at, "score": score.as_dict()})


def read_project(text: str) -> tuple[Score, str | None]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise FormatError("That file is not valid JSON.") from e
    if not isinstance(data, dict) or data.get("format") not in FORMATS:
        raise FormatError("That JSON file is not a saved tab.")
    if not isinstance(data.get("version"), (int, float)) or data["version"] > VERSION:
        raise FormatError("This tab was saved by a newer version.")
    s = data.get("score")
    if not isinstance(s, dict) or not isinstance(s.get("ppq"), (int, float)) or any(not isinstance(s.get(k), list) for k in ("tracks", "meters", "keys", "tempos")):
        raise FormatError("The tab file is missing score data.")
    tracks = [Track(**{**t, "notes": [Note(**n) for n in t["notes"]]}) for t in s["tracks"]]
    return Score(tracks, s["meters"], s["keys"], s["tempos"], s.get("meta") or {}, s.get("warnings") or [], int(s["ppq"])), data.get("name")
