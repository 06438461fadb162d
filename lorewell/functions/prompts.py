"""Prompts as string columns: templates whose places are filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\{([a-z_]+)\}")

QUESTIONS = 'Base: {base}\nWrite {n} questions that this text answers, and their answers, as a JSON list of {{"question", "answer"}}.\nText:\n{content}'
RECORDS = 'Kinds of entities: {kinds}\nList entities as ("entity"<|>name<|>kind<|>description) and relations as ("relationship"<|>source<|>target<|>kind<|>description<|>weight), separated by ##, and end with <|DONE|>.\nText:\n{content}'
MORE_RECORDS = "Some entities or relations of the text are missing from the list so far. Add them in the same format, or answer <|DONE|>.\nSo far:\n{so_far}"
BOUNDARIES = 'Sentences:\n{sentences}\nReturn a JSON list of {n} objects {{"is_boundary", "header"}}, one for each two neighbours: whether the topic changes, and the title of the new one.'

COMMUNITY = 'These entities and relations of a knowledge graph belong together.\nEntities (number, name, description):\n{entities}\nRelations (number, source, target, description):\n{relations}\nWrite a report on them, from this text alone, as JSON: {{"title", "summary", "rating" (0 to 10: how much they matter), "rating_explanation", "findings": [{{"summary", "explanation"}}]}}.'


def filled(template: str, **values: Column | str | int) -> Column:
    """``template`` with ``{name}`` places filled; ``{{`` and ``}}`` stand for braces. Missing values raise, null ones are empty."""
    parts, at = [], 0
    text = template.replace("{{", "\x01").replace("}}", "\x02")
    plain = lambda s: F.lit(s.replace("\x01", "{").replace("\x02", "}"))
    for m in PLACE.finditer(text):
        value = values[m.group(1)]
        parts += [plain(text[at : m.start()]), F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(str(value))]
        at = m.end()
    return F.concat(*parts, plain(text[at:]))


def numbered(sentences: Column) -> Column:
    """Sentences as lines with their numbers."""
    return F.array_join(F.transform(sentences, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
