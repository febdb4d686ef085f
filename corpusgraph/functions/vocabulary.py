"""What kinds of entity and relation there are, as prompts state them. Change a version when its text changes."""

# The names.
ENTITY_TYPES = {
    "resource": "the carrier itself, such as a book, a chapter or a repository, and not what it tells",
    "criterion": "a measure of good and bad or a goal of optimisation; what computes it is a solution",
    "data": "a certain collection of records; its mathematical form is a concept",
    "task": "what is to be done, with known input, output or condition of success; how it is done is a solution",
    "solution": "how something is done: a method, model, algorithm or system",
    "concept": "an idea, an object of theory or a field, where none of the others holds",
}
RELATIONS = {
    "is_a": "every subject is a kind of object; excluded: parts, uses, and a certain carrier of a subject",
    "part_of": "the subject is a component of the object; excluded: kinds, and words that merely occur together",
    "prerequisite_of": "the object can't be understood without the subject; excluded: an order of chapters",
}
POLARITIES = ("support", "oppose")


def listed(meanings: dict[str, str]) -> str:
    return "\n".join(f"{k}: {v}" for k, v in meanings.items())
