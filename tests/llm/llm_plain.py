"""Plain Python restatements that several tests hold results against."""

from ledgerlens.llm import decontamination as D
from test_decontamination import plain_score, words
from test_ngram_join import brute_force
from test_secret_scan import brute_force as secrets  # noqa: F401


def links(texts):
    """{doc_id: smallest id of its group}."""
    return {i: component for i, (_, component) in brute_force(texts).items()}


def leaks(text, items):
    """Ids of the items that a text holds; only texts that share three words in a row with an item are aligned."""
    own = words(text)
    grams = {tuple(own[k : k + 3]) for k in range(len(own) - 2)}
    found = []
    for item, passage in items:
        theirs = words(passage)
        if len(theirs) >= D.LEAST_WORDS and any(tuple(theirs[k : k + 3]) in grams for k in range(len(theirs) - 2)):
            if plain_score(theirs, own) >= D.THRESHOLD * D.MATCH * len(theirs):
                found.append(item)
    return found
