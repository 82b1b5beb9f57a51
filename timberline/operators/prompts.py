"""Prompt texts as Column expressions. The wording is this project's own and can be replaced by templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.schema import KEY_NAMES

#: What each key is about, for the classification prompt.
KEY_HINTS = {
    "A": "a feeling or mood, named or shown",
    "B-O": "something the writer does towards other people",
    "B-S": "something the writer does to or for themself",
    "C-O": "how the writer sees other people",
    "C-S": "how the writer sees themself",
    "D": "a need, wish or expectation",
}


#: What each key looks like in either state, for the classification prompt.
KEY_EXAMPLES = {
    "A": {"adaptive": "at ease, content, hopeful, moved", "maladaptive": "numb, on edge, dejected, ashamed"},
    "B-O": {"adaptive": "asking for help, staying in touch", "maladaptive": "lashing out, shutting people out"},
    "B-S": {"adaptive": "keeping a routine, resting, seeking treatment", "maladaptive": "neglecting or harming oneself"},
    "C-O": {"adaptive": "others seen as kind or reliable", "maladaptive": "others seen as cold or hostile"},
    "C-S": {"adaptive": "seeing oneself as worthy or able", "maladaptive": "blaming or belittling oneself"},
    "D": {"adaptive": "wanting closeness, growth or calm", "maladaptive": "expecting that nothing good will come"},
}


def _name(key: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in KEY_NAMES.items() for x in kv])
    return F.coalesce(names[key], key)


def evidence_block(spans: Column) -> Column:
    """Two sections from an array of ``struct<polarity, abcd_key, text>`` in span order."""

    def section(title: str, polarity: str) -> Column:
        own = F.filter(spans, lambda s: s["polarity"] == polarity)
        lines = F.transform(own, lambda s: F.concat(F.lit("  - "), _name(s["abcd_key"]), F.lit(" ("), s["abcd_key"], F.lit('): "'), s["text"], F.lit('"')))
        return F.concat(F.lit(title + "\n"), F.when(F.size(own) > 0, F.array_join(lines, "\n")).otherwise("  None identified"))

    return F.concat(section("Adaptive evidence:", "adaptive"), F.lit("\n"), section("Maladaptive evidence:", "maladaptive"))


def context_block(before: Column, after: Column) -> Column:
    """Posts around the target, each with its index; '' without any. Headings and line form are fixed values."""

    def part(title: str, posts: Column) -> Column:
        line = lambda p: F.concat(F.lit("  [post "), p["post_index"].cast("string"), F.lit('] "'), p["post_text"], F.lit('"'))
        return F.when(F.size(posts) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(posts, line), "\n"))).otherwise("")

    a, b = part("Earlier posts in this timeline:", before), part("Later posts in this timeline:", after)
    return F.concat(a, F.when((a != "") & (b != ""), "\n").otherwise(""), b)


def classification(post: Column, span: Column, polarity: Column, use_post: bool = True) -> Column:
    """Keys with examples of the polarity, the post with the passage marked (or beside it, where it isn't found), the passage.

    No other post of the timeline is shown; without ``use_post`` the passage stands alone.
    """
    state = F.initcap(polarity)
    hints = lambda p: "\n".join(f"{k} ({KEY_NAMES[k]}): {v}. For example: {KEY_EXAMPLES[k][p]}." for k, v in KEY_HINTS.items())
    keys = F.when(polarity == "adaptive", hints("adaptive")).otherwise(hints("maladaptive"))
    text, found = T.highlight(post, span)
    shown = F.concat(F.when(found, "The post, with the passage between « and »:\n").otherwise("The post:\n"), text, F.lit("\n"))
    return F.concat(F.lit("Which key fits the passage? It shows an "), state, F.lit(" state.\n"), keys, F.lit("\n"), shown if use_post else F.lit(""), F.lit("Passage ("), state, F.lit("): "), span, F.lit("\nKey:"))


def zero_shot(post: Column, evidence: Column, wellbeing: Column, context: Column | None = None) -> Column:
    head = F.when(context != "", F.concat(context, F.lit("\n"))).otherwise("") if context is not None else F.lit("")
    return F.concat(F.lit("Sum up the mental state in this post.\n"), head, F.lit("Post:\n"), post, F.lit("\n"), evidence, F.lit("\nWell-being (1-10): "), T.wellbeing_text(wellbeing), F.lit("\nSummary:"))


def one_shot(post: Column, evidence: Column, wellbeing: Column, example_post: Column, example_evidence: Column, example_wellbeing: Column, example_summary: Column, context: Column | None = None) -> Column:
    """Null without an example."""
    example = F.concat(F.lit("Example post:\n"), example_post, F.lit("\n"), example_evidence, F.lit("\nWell-being (1-10): "), T.wellbeing_text(example_wellbeing), F.lit("\nSummary: "), example_summary, F.lit("\n\n"))
    return F.concat(example, zero_shot(post, evidence, wellbeing, context))


#: What the answers of the baselines are cut at. Fixed values.
POST_MARKER, TIMELINE_MARKER = "Summary :\n", "Timeline Summary :\n"


def baseline(text: Column, whole_timeline: bool = False, as_json: bool = False) -> Column:
    """The four baseline prompts: one post or a whole timeline, answered after a marker or as JSON."""
    what = "all posts of one person, in order" if whole_timeline else "one post"
    end = '{"summary": "..."}' if as_json else (TIMELINE_MARKER if whole_timeline else POST_MARKER)
    ask = "Answer as JSON of this form:\n" if as_json else ""
    return F.concat(F.lit(f"Here is {what}. Summarize it in a few sentences.\n"), text, F.lit(f"\n{ask}{end}"))
