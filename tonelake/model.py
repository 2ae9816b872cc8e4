"""Schemas of the score tables.

Time is in ticks, ``ppq`` of them to a quarter note; pitch is a MIDI number;
string 0 is the highest; frets count from the nut.  Every change-point table
carries ``ord``, the place in its list, since lookups go by list order.
"""

from __future__ import annotations

DEFAULT_PPQ = 480

SCORES = "score_id long, ppq int, title string, composer string, source string, warnings array<string>, meta_json string"
TRACKS = "score_id long, track_ord int, track_id string, name string, program int, is_guitar_target boolean"
NOTES = (
    "score_id long, track_ord int, note_ord int, pitch int, start_tick long, duration long, velocity int, voice int, "
    "spelling struct<step:string,alter:int,octave:int>, tab struct<string:int,fret:int>, tab_locked boolean, "
    "tied_from_previous boolean, articulations array<string>, confidence double"
)
TIME_SIGNATURES = "score_id long, ord int, tick long, numerator int, denominator int"
KEY_SIGNATURES = "score_id long, ord int, tick long, fifths int, mode string"
TEMPOS = "score_id long, ord int, tick long, bpm double"
PRINTED_CHORDS = (
    "score_id long, ord int, measure int, tick long, text string, root string, quality string, bass string, "
    "confidence double, repaired boolean, ocr_conf double"
)
LIBRARY = "id string, name string, created_at long, updated_at long, thumbnail string, preview string"

# Tunings, string 0 (highest) first.
TUNINGS = {
    "Standard (EADGBE)": (64, 59, 55, 50, 45, 40),
    "Drop D": (64, 59, 55, 50, 45, 38),
    "Half-step down (Eb)": (63, 58, 54, 49, 44, 39),
    "Whole-step down (D)": (62, 57, 53, 48, 43, 38),
    "DADGAD": (62, 57, 55, 50, 45, 38),
    "Open G": (62, 59, 55, 50, 43, 38),
    "Open D": (62, 57, 54, 50, 45, 38),
    "Drop C": (62, 57, 53, 48, 43, 36),
}
STANDARD = TUNINGS["Standard (EADGBE)"]
MAX_FRET = 22
