"""Prompt texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that a model sees must stay the same for comparable replies.
SUMMARY_PROMPT = (
    "Below is a code chunk. Write a summary for this chunk's logic within 150 words. "
    "The summary should only include relavent details and not be wordy. "
    "Only return the summary in plain english. \n\n"
)
ANSWER_PROMPT = (
    "Below is some context. Answer the question based on the context. "
    "The answer should only include relavent details and not be wordy. "
    "Only return the answer in plain english. \n\n"
)
CHOICE_PROMPT = (
    "Below is a query and two contexts. Answer which context is more relavent. "
    "Only return the answer as 'smart' or 'naive' \n\n"
)
SHORT_ANSWER_HEAD = "Here are some relevant code chunks based on the query: '%s'\n\n%s\n\n"
SHORT_ANSWER_TAIL = (
    "Using the code chunks above, generate a summary of the logic relevant to the query. "
    "Keep it under 150 words, do not include irrelevant info."
)
CONTEXT_SEPARATOR = "\n\n---\n\n"
QUESTION_PROMPT = (
    "Answer the query given below only based on the context provided\n\nQuery: %s\n"
)
PREFERENCE_PROMPT = (
    '\nYou are a technical expert. A user asked: "%s"\n\n'
    "Here are two responses:\nResponse A:\n%s\n\nResponse B:\n%s\n\n"
    "Based only on their usefulness and informativeness for the query, which response "
    "is better? Reply with only 'A' or 'B'.\n"
)


def filled(template: str, *values: Column) -> Column:
    """``template`` with its ``%s`` replaced; null if a value is null."""
    head, *rest = template.split("%s")
    parts = [F.lit(head)]
    for value, text in zip(values, rest, strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)


def summary_prompt(chunk: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT), chunk)


def answer_prompt(query: Column, context: Column) -> Column:
    return F.concat(
        F.lit(ANSWER_PROMPT + "Query: "), query, F.lit("\n\nContext: "), context
    )


def choice_prompt(query: Column, smart: Column, naive: Column) -> Column:
    return F.concat(
        F.lit(CHOICE_PROMPT + "Query: "),
        query,
        F.lit("\n\nSmart Context: "),
        smart,
        F.lit("\n\nNaive Context: "),
        naive,
    )


def short_answer_prompt(query: Column, contexts: Column) -> Column:
    """``contexts`` is an array of texts."""
    joined = F.array_join(contexts, CONTEXT_SEPARATOR)
    return F.concat(filled(SHORT_ANSWER_HEAD, query, joined), F.lit(SHORT_ANSWER_TAIL))


def question_prompt(query: Column) -> Column:
    return filled(QUESTION_PROMPT, query)


def preference_prompt(query: Column, response_a: Column, response_b: Column) -> Column:
    return filled(PREFERENCE_PROMPT, query, response_a, response_b)
