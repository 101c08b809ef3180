"""Hesitations: fixed values and the test whether a text says anything besides them."""

from __future__ import annotations

import re

#: Filler words and phrases by language (a yes or no is none).
FILLERS = {
    "en": "um uh uh-huh erm er hmm mm mhm ah eh you know",
    "de": "ähm äh hm öh",
    "fr": "euh ben heu",
    "es": "este eh em",
    "pt": "hum hã é ã",
    "ru": "э э-э мм эм ммм",
    "zh": "嗯 呃 啊 那个 嗯嗯 额",
    "ja": "えっと あの まあ うーん ええと",
    "ko": "음 어 저기 그",
    "ar": "آه أمم اه امم",
    "hi": "उम अँ अं",
    "th": "อืม เอ่อ อ่า",
}

WORDS = {w for v in FILLERS.values() for w in v.split()} - {"you", "know"}

_TOKEN_MARKS = re.compile(r"[\wऀ-ॿ฀-๿ً-ٟ]+(?:[-'’][\w]+)*")


#: Words that hesitate only at the head of a sentence, before a comma or dots.
LEAD_INS = {"bueno", "enfin", "ну", "nun ja", "well", "also", "alors", "pues"}


def is_speech(masked: str, low: str | None = None) -> bool:
    """Whether anything but fillers is said in a text whose trimmings are blanked (a yes or no is speech, empty text none).

    ``low``: the text in lower case, where it is at hand.
    """
    you = said = False
    for m in _TOKEN_MARKS.finditer(masked.lower() if low is None else low):
        said, w = True, m[0]
        if you:
            if w != "know":
                return True
            you = False
        elif w == "you":
            you = True
        elif w not in WORDS:
            return True
    return you or (not said and any(ch.isalnum() for ch in masked))
