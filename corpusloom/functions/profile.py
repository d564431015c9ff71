"""Profiles: what an analysis looks for.

default has the word lists of the news analyses; fixture has words that occur
in the synthetic test tables, so that every operator can be exercised there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from corpusloom.functions import lexicons as L


@dataclass(frozen=True)
class Profile:
    anchors: dict[str, list[str]] = field(default_factory=lambda: L.COUNTRY_TERMS)
    referents: dict[str, list[str]] = field(default_factory=lambda: L.REF_KEYWORDS)
    stopwords: list[str] = field(default_factory=lambda: L.STOPWORDS_CORE)
    strict_stopwords: list[str] = field(default_factory=lambda: L.STOPWORDS_STRICT)
    positive: dict[str, list[str]] = field(default_factory=lambda: L.SENT_POS_BY_LANG)
    negative: dict[str, list[str]] = field(default_factory=lambda: L.SENT_NEG_BY_LANG)
    any_positive: list[str] = field(default_factory=lambda: L.SENT_POS)
    any_negative: list[str] = field(default_factory=lambda: L.SENT_NEG)
    frames: dict[str, dict[str, list[str]]] = field(default_factory=lambda: L.FRAME_LEXICONS_BY_LANG)
    any_frames: dict[str, list[str]] = field(default_factory=lambda: L.FRAME_LEXICONS)
    persuasion: dict[str, dict[str, list[str]]] = field(default_factory=lambda: L.PERSUASION_MARKERS_BY_LANG)
    any_persuasion: dict[str, list[str]] = field(default_factory=lambda: L.PERSUASION_MARKERS)
    ideology: dict[str, list[str]] = field(default_factory=lambda: L.IDEOLOGY_MARKERS)
    emotion: dict[str, list[str]] = field(default_factory=lambda: L.EMOTION_MARKERS)
    metaphor: dict[str, list[str]] = field(default_factory=lambda: L.METAPHOR_MARKERS)
    ideological_terms: list[str] = field(default_factory=lambda: L.IDEOLOGICAL_TERMS)
    emotional_terms: dict[str, list[str]] = field(default_factory=lambda: L.EMOTIONAL_TERMS)
    metaphor_terms: list[str] = field(default_factory=lambda: [t for ts in L.METAPHOR_TERMS.values() for t in ts])
    rubric: dict[str, tuple[list[str], list[str], int]] = field(
        default_factory=lambda: {
            "lex": (L.RUBRIC_POS_LEX, L.RUBRIC_NEG_LEX, 3),
            "action": (L.RUBRIC_POS_ACTION, L.RUBRIC_NEG_ACTION, 2),
            "consequence": (L.RUBRIC_POS_CONSEQUENCE, L.RUBRIC_NEG_CONSEQUENCE, 2),
            "frame": (L.RUBRIC_POS_FRAME, L.RUBRIC_NEG_FRAME, 2),
        }
    )
    authority: list[str] = field(default_factory=lambda: L.AUTHORITY_CUES)
    neutral_actions: list[str] = field(default_factory=lambda: L.NEUTRAL_ACTION_CUES)
    capitals: dict[str, str] = field(default_factory=lambda: {"USA": "washington", "China": "beijing", "Russia": "moscow"})


def default() -> Profile:
    return Profile()


def fixture() -> Profile:
    """Words that the test tables hold, some rare and some in every other text."""
    return Profile(
        anchors={"alpha": ["worthless", "stupid"], "beta": ["license", "work"], "gamma": ["threat"]},
        referents={"Alpha": ["worthless", "stupid"], "Beta": ["license", "licensed"], "Gamma": ["with"]},
        positive={"en": ["work", "public", "general"], "fr": ["une", "pour"], "de": ["eine", "und"], "es": ["que", "los"]},
        negative={"en": ["stupid", "worthless", "threat"], "fr": ["des", "les"], "de": ["der", "von"], "es": ["por", "las"]},
        any_positive=["work"],
        any_negative=["threat"],
        frames={"en": {"law": ["license", "licensed", "terms"], "abuse": ["stupid", "worthless"]}, "de": {"law": ["lizenz"], "abuse": ["der"]}},
        any_frames={"law": ["licence"], "abuse": ["les", "por"]},
        persuasion={"en": {"possibility": ["can", "could", "may"], "evaluation": ["worthless", "stupid"]}},
        any_persuasion={"possibility": ["que", "des"], "evaluation": ["die"]},
        ideology={"ideol": ["general", "public"], "prec": ["license"], "slog": ["work"], "dich": ["threat", "people"]},
        emotion={"weak": ["stupid"], "medium": ["worthless"], "strong": ["threat"]},
        metaphor={"weak": ["version"], "medium": ["terms"], "strong": ["software"]},
        ideological_terms=["license", "general public", "public"],
        emotional_terms={"weak": ["stupid"], "medium": ["worthless"], "strong": ["threat"]},
        metaphor_terms=["work", "this work"],
        rubric={"lex": (["for", "work"], ["stupid", "worthless"], 3), "action": (["licensed"], ["are"], 2), "consequence": (["public"], ["threat"], 2), "frame": (["this work"], ["the worthless"], 2)},
        authority=["under the"],
        neutral_actions=["said", "was"],
        capitals=dict.fromkeys(("Alpha", "Beta", "Gamma"), "capital"),
    )
