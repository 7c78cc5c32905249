"""Prompts of the model stages, in the library's own words. ``{name}`` fields are filled by plain replacement."""

from __future__ import annotations

from quire.schemas import ENTITY_TYPES, RELATION_ENDS

#: What a compression returns where a source says nothing on the question; what marks a failed one.
IRRELEVANT, FAILED = "NO RELEVANT INFORMATION", "COMPRESSION FAILED: "
NO_SOURCE = "No source in the library answers this question."

EXTRACTION = (
    "Read the passage of the paper titled \"{title}\" and reply with one JSON object with the lists entities, relations and performances.\n"
    f"An entity has a name and a type out of {', '.join(ENTITY_TYPES)}; the paper itself is no entity. Write each name in its usual form.\n"
    f"A relation has head, relation and tail; relation is one of {', '.join(RELATION_ENDS)}. Where the paper is the head, write its title.\n"
    "A performance has method, metric, value, condition and dataset, with the value exactly as printed, one row for each metric, and an empty text for what is not given.\n"
    "Report only what the passage says.\n---\n{text}"
)
COMPRESSION = (
    "Question: {question}\nSource [{number}]: {source}\n"
    "State what the source below says on the question, a sentence for each point, with methods and numbers kept. Add nothing. "
    f"If it says nothing on the question, reply {IRRELEVANT} and nothing else."
)
ANSWER = (
    "Question: {question}\nAnswer from the numbered points below and nothing else, citing them as [1], [2]. "
    "Say so if they don't suffice."
)
DEMO = "Question: {question}\nAnswer from the context below. If it does not hold the answer, reply: The context does not say."


def fill(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template
