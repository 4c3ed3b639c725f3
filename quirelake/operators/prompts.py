"""Prompts for a translation model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import compact

SYSTEM = "You are a professional translator."
# Fixed value: the template and the sentence before a context.
TEMPLATE = """Translate the following text into fluent and accurate {TARGET_LANGUAGE}.

Requirements:

- Preserve all information.
- Do not summarize.
- Do not explain.
- Do not omit content.
- Preserve names, references, citations, and technical terminology.
- Strictly follow any locked terminology provided below; never use alternative
  transliterations for those source terms.
- Maintain paragraph structure whenever possible.
- Produce natural and readable {TARGET_LANGUAGE}.
- If the text contains numbered items, return exactly the same item numbers in the same order.

{DOCUMENT_CONTEXT_SECTION}{CONTEXT_SECTION}{TERMINOLOGY_SECTION}Text:

{TEXT}"""
CONTEXT_LEAD = "Context for consistency only. Do not translate this context unless it also appears in the Text section:\n\n"


def document_context(book_title: Column, chapter_heading: Column, file_name: Column, kind: Column) -> Column:
    """Book, chapter (or else the item's file) and kind of a line as a prompt section; '' where nothing is known."""
    book, chapter, file = compact(F.coalesce(book_title, F.lit("")), 120), compact(F.coalesce(chapter_heading, F.lit("")), 120), compact(F.coalesce(file_name, F.lit("")), 80)
    place = F.when((chapter != "") & (chapter != book), F.concat(F.lit("Chapter: "), chapter)).when(file != "", F.concat(F.lit("EPUB item: "), file))
    lines = F.concat_ws("\n", F.when(book != "", F.concat(F.lit("Book: "), book)), place, F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("Block kind: "), kind)))
    return F.when(lines == "", "").otherwise(F.concat(F.lit("Document context for consistency only:\n"), lines, F.lit("\n\n")))


def render(text: Column, language: Column, context: Column, terminology: Column, document: Column, template: str = TEMPLATE) -> Column:
    """The prompt of each row. The template is cut at its placeholders once, so that values holding a placeholder's name are not expanded."""
    if "{TEXT}" not in template:
        raise ValueError("the template must hold the {TEXT} placeholder")
    blank = F.lit("")
    context, document = F.coalesce(context, blank), F.coalesce(document, blank)
    section = F.when(context == "", "").otherwise(F.concat(F.lit(CONTEXT_LEAD), context, F.lit("\n\n")))
    values = {"TARGET_LANGUAGE": F.coalesce(language, blank), "DOCUMENT_CONTEXT_SECTION": document, "DOCUMENT_CONTEXT": F.btrim(document), "TERMINOLOGY_SECTION": F.coalesce(terminology, blank), "CONTEXT_SECTION": section, "CONTEXT": context, "TEXT": F.coalesce(text, blank)}
    parts = re.split("\\{(" + "|".join(values) + ")\\}", template)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def chat(prompt: Column) -> Column:
    """The messages of a chat model."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM)), message("user", prompt))
