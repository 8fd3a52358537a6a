"""Word lists of the lexical rules, and the terms that a text must not name."""

from __future__ import annotations

from pyspark.sql import Column

from vectrine.functions.text import terms_found

# Each label with its direct synonyms.
SYNONYMS = {
    "excited": ("excitement", "eager", "eagerness", "thrill", "thrilled", "anticipation"),
    "elated": ("delight", "delighted", "overjoyed", "exhilarated", "exhilaration"),
    "ecstatic": ("euphoric", "euphoria", "rapturous", "rapture", "blissful", "bliss"),
    "enthusiastic": ("enthusiasm", "zealous", "zeal", "passionate"),
    "joyful": ("joy", "happy", "happiness", "glad", "gleeful"),
    "content": ("contented", "satisfied", "satisfaction", "fulfilled"),
    "calm": ("peaceful", "tranquil", "composed", "unruffled"),
    "serene": ("serenity", "tranquility", "placid"),
    "grateful": ("gratitude", "thankful", "appreciative"),
    "relaxed": ("relaxation", "at ease", "unworried", "laid-back"),
    "angry": ("anger", "mad", "irate", "rage", "enraged"),
    "furious": ("fury", "raging", "infuriated", "livid"),
    "terrified": ("terror", "afraid", "frightened", "horrified"),
    "anxious": ("anxiety", "worried", "worry", "uneasy", "nervous"),
    "panicked": ("panic", "frantic", "alarmed"),
    "outraged": ("outrage", "indignant", "indignation", "offended"),
    "sad": ("sadness", "grief", "grieving", "sorrow", "unhappy", "tearful"),
    "depressed": ("depression", "hopeless", "hopelessness", "despair", "despondent"),
    "gloomy": ("gloom", "bleak", "somber", "dreary"),
    "lonely": ("loneliness", "lonesome", "isolated"),
    "miserable": ("misery", "wretched", "suffering"),
    "bored": ("boredom", "uninterested", "tedious", "dull"),
    "surprised": ("surprise", "astonished", "astonishment", "startled", "amazed"),
    "proud": ("pride", "self-satisfied"),
    "hopeful": ("hope", "optimistic", "optimism"),
    "nostalgic": ("nostalgia", "wistful", "reminiscent"),
    "guilty": ("guilt", "remorse", "remorseful", "culpable"),
    "ashamed": ("shame", "embarrassed", "humiliated", "disgraced"),
    "jealous": ("jealousy", "envious", "envy", "possessive"),
    "disgusted": ("disgust", "revolted", "repulsed", "revulsion", "nauseated"),
}
# What a neutral text must not say.
NEUTRAL_BANS = ("emotion", "emotions", "emotional", "emotionally", "feeling", "feelings", "thank you", "thanks", "great question", "happy to help", "glad to help", "sorry")
# Words that carry no topic.
TOPIC_STOPS = ("a", "an", "the", "their", "they", "them", "someone", "someones", "person", "persons", "two", "out", "finds", "find", "discovers", "learns", "receives", "gets", "has", "have", "is", "was", "are", "to", "of", "for", "in", "on", "from", "with", "that")


def terms_of(labels: list[str], neutral: bool = False) -> list[str]:
    """Sorted labels and synonyms, and for a neutral text the general bans; the noun content is allowed in a neutral text."""
    out: set[str] = set(NEUTRAL_BANS) if neutral else set()
    for label in (x.strip().lower() for x in labels):
        out.update(SYNONYMS.get(label, ()))
        if label and not (neutral and label == "content"):
            out.add(label)
    return sorted(out)


def forbidden(text: Column, labels: list[str], neutral: bool = False) -> Column:
    """The terms of the labels that a text names, sorted and joined by commas; empty if none."""
    return terms_found(text, terms_of(labels, neutral))
