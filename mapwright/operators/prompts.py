"""Prompts of the judging stages: templates with <<names>>, filled in as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapwright.functions import text as T

_VERDICT = """Answer with one JSON object: {"type": "MappingRationale", "is_compliant": true or false,
"compliance_level": "fully_compliant", "partially_compliant" or "non_compliant",
"confidence_score": 0 to 1, "explanation": "..."} or, if the text does not bear on the control,
{"type": "InsufficientEvidence", "reason": "...", "required_context": "..."}."""

TEMPLATES = {
    "compliance_rationale": "Judge whether the policy text meets the control.\n\n## Control\n<<control_text>>\n\n## Policy text\n<<chunk_text>>\n\n## Answer\n" + _VERDICT,
    "merged_relevance_rationale": "Decide first whether the policy text bears on the control, and if so whether it meets it.\n\n## Control\n<<control_text>>\n\n## Family\n<<requirement_family>>\n\n## Policy text\n<<chunk_text>>\n\n## Answer\n" + _VERDICT,
    "batch_evaluation": "Judge each of <<chunk_count>> policy texts against the control, each on its own.\n\n## Control\n<<control_text>>\n\n## Family\n<<requirement_family>>\n\n## Policy texts\n<<numbered_chunks>>\n\n## Answer\nA JSON array with one object for each text in order. "
    + _VERDICT
    + '\nAdd "chunk_index" and, for a rationale, "sub_requirements": [{"requirement": "...", "covered": true or false, "evidence": "..."}].',
    "relevance_check": 'Say whether the policy text is direct evidence for the control; shared words are not enough.\n\n## Control\n<<control_text>>\n\n## Family\n<<requirement_family>>\n\n## Policy text\n<<chunk_text>>\n\n## Answer\n{"relevant": true or false}',
    "meta_classification": 'Say whether the control governs other requirements (their documentation, roles or upkeep) rather than asking for a safeguard of its own.\n\n## Control\n<<control_text>>\n\n## Answer\n{"is_meta": true or false}',
    "batch_meta_classification": 'Say of each of <<control_count>> controls whether it governs other requirements rather than asking for a safeguard of its own.\n\n## Controls\n<<numbered_controls>>\n\n## Answer\nA JSON array of {"control_index": number, "is_meta": true or false}.',
    "gap_rationale": "No policy text was found for the control. Explain the gap and what a policy would have to say.\n\n## Control\n<<control_text>>\n\n## Answer\n" + _VERDICT,
    "control_extraction": 'List the requirements that the text states, in its own words.\n\n## Text\n<<segment>>\n\n## Answer\nA JSON array of {"section": "number or empty", "text": "..."}.',
}
UNKNOWN_FAMILY = "Not specified"


def load_prompt(name: str) -> str:
    """A template by name, with or without the ending of a text file."""
    bare = name.removesuffix(".txt")
    if bare not in TEMPLATES:
        raise FileNotFoundError(f"no prompt named {name}")
    return TEMPLATES[bare]


def prompt(name: str, **values: Column) -> Column:
    if "requirement_family" in values:
        family = values["requirement_family"]
        values["requirement_family"] = F.when(F.coalesce(family, F.lit("")) != "", family).otherwise(UNKNOWN_FAMILY)
    return T.filled(load_prompt(name), **values)


def numbered(kind: str, texts: Column) -> Column:
    """Texts under numbered headings, from 0 on."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(f"### {kind} "), i, F.lit("\n"), t)), "\n")


def with_source(chunk: Column) -> Column:
    """A chunk's text, cut for a prompt, under a line that names its document and section."""
    section = F.when(F.coalesce(chunk["section_header"], F.lit("")) != "", F.concat(F.lit(" | Section: "), chunk["section_header"])).otherwise("")
    return F.concat(F.lit("[Source: "), chunk["document_name"], section, F.lit("]\n"), T.truncate_at_sentence(chunk["raw_text"]))
