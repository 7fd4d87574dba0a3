"""Two small snapshots and what mining them has to give."""

from datetime import datetime

XSD_DATE = "http://www.w3.org/2001/XMLSchema#date"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
KNOWS = "http://xmlns.com/foaf/0.1/knows"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
EX = "http://example.org/"

ACME = f"{EX}worksAt={EX}AcmeCorp"
ENGINEER = f"{TYPE}={EX}Engineer"
KNOWS_BOB = f"{KNOWS}={EX}Bob"


def _line(subject, predicate, obj):
    return f"<{EX}{subject}> <{predicate}> {obj} ."


SNAPSHOT_LINES = {
    "2023": [
        _line("Alice", KNOWS, f"<{EX}Bob>"),
        _line("Alice", f"{EX}worksAt", f"<{EX}AcmeCorp>"),
        _line("Bob", f"{EX}worksAt", f"<{EX}AcmeCorp>"),
        _line("Alice", TYPE, f"<{EX}Engineer>"),
        _line("Bob", TYPE, f"<{EX}Engineer>"),
        "# two literals",
        _line("Alice", f"{EX}hireDate", f'"2023-01-15"^^<{XSD_DATE}>'),
        _line("Alice", LABEL, '"Alice"@en'),
    ],
    "2024": [
        _line("Alice", KNOWS, f"<{EX}Bob>"),
        _line("Alice", KNOWS, f"<{EX}Carol>"),
        _line("Alice", f"{EX}worksAt", f"<{EX}AcmeCorp>"),
        _line("Carol", f"{EX}worksAt", f"<{EX}AcmeCorp>"),
        _line("Bob", f"{EX}worksAt", f"<{EX}Globex>"),
        _line("Alice", TYPE, f"<{EX}Engineer>"),
        _line("Carol", TYPE, f"<{EX}Engineer>"),
        _line("Carol", f"{EX}hireDate", f'"2024-03-02"^^<{XSD_DATE}>'),
    ],
}


def write_snapshots(folder):
    sources = {}
    for snapshot, lines in SNAPSHOT_LINES.items():
        path = folder / f"{snapshot}.nt"
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        sources[snapshot] = (str(path), datetime(int(snapshot), 1, 1))
    return sources
