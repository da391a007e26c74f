"""Forms of lines, written as phrases instead of patterns, and the word lists that the scanners share."""

from __future__ import annotations

import re

# What a brace stands for in a form; any other brace content is a repetition of digits.
_SLOTS = {"n": r"\d+", "kind": "[12lI]", "cap": "[A-Z]", "any": ".*", "eol": r"[^\n]*"}


def _pattern(form: str) -> str:
    out = []
    for token in form.split():
        pieces = re.split(r"\{([^}]*)\}", token)
        out.append("".join(_SLOTS.get(p, rf"\d{{{p}}}") if i % 2 else re.escape(p) for i, p in enumerate(pieces)))
    return r"\s+".join(out)


def phrases(forms: str) -> re.Pattern:
    """One pattern for forms separated by ``;``: blanks match any whitespace, ``{4}`` four digits, ``{n}`` a number, letter case does not count."""
    return re.compile("(?:" + "|".join(_pattern(f) for f in re.split(r";\s+", forms.strip()) if f) + ")", re.I)


def names(text: str) -> frozenset[str]:
    """A set of names separated by ``;`` or line ends."""
    return frozenset(x.strip() for x in re.split(r"[;\n]", text) if x.strip())


# The headings that a line may be on its own.
EXACT_HEADINGS = names("""
abstract; introduction; methodology; methods; method; results; discussion; conclusion; conclusions; references; background
related work; related works; experiments; experimental setup; evaluation; limitations; future work; acknowledgments; acknowledgements
motivation; keywords; index terms; article info; history; system overview; problem statement; claims; what is claimed is; it is claimed
we claim; the invention claimed is; detailed description; summary; summary of the invention; brief summary; background of the invention
field of the invention; technical field; description of embodiments; description; brief description of the drawings
cross-reference to related applications; cross reference to related applications
""")
# Headings of claims.
CLAIMS_HEADINGS = names("claims; what is claimed is; it is claimed; we claim; the invention claimed is")
# Sections that say nothing about the matter.
BOILERPLATE = names("""
acknowledgment; acknowledgments; acknowledgement; acknowledgements; aknowledgement; ai use statement; declaration of llm usage
use of generative ai tools; reproducibility statement; code of ethics; broader impacts; safeguards; licenses for existing assets; new assets
crowdsourcing and research with human subjects; theory assumptions and proofs; experimental result reproducibility
open access to data and code; experiment statistical significance; experiments compute resources; article info; history; keywords; index terms
""")
# Titles of subsections that say nothing without their section.
GENERIC_SUBSECTIONS = names("""
data acquisition; first iteration; second iteration; plausibility verification; simulation controller; sensor module; phase noise
rf group delay; phase imbalance; mixer non-linearity; receiver noise and noise figure; signal processing; object recognition
angles estimation; setup; calibration; testing; analysis; main results; ablation study; ablations; qualitative results
implementation details; implement details; validation of sensor-specific impairments modeling
""")
# How claims and sentences start that are numbered as headings are, and words inside them that no heading has.
CLAIM_STARTS = phrases("""a; an; the; one or more; at least one; each; wherein; in claim; according to; method of; system of; device of; apparatus of; non-transitory;
computer implemented; computer-implemented; computer readable; computer-readable; vehicular; humanoid; electronic control""")
SENTENCE_STARTS = phrases("a; an; one or more; at least one; each; wherein; in claim; according to; we; in this; for each; as shown; to evaluate; first; second; third; finally")
CLAIM_WORDS = phrases("""comprising; comprises; configured; includes; including; having; storing; wherein; claim; claims; instructions; plurality; operable; coupled; connected; disposed;
executing; executed; may be; can be; is a; are a""")
SENTENCE_WORDS = phrases("was a; were a; show that; shows that; demonstrate; demonstrates")
# Prefixes after which a hyphen at a line end belongs to the word.
HYPHEN_PREFIXES = frozenset(
    """end real state self high low closed open multi co three two one object event ray spatial geo human non tool sensor purpose cost user
long fine chain pre post cross range time frame data model system vehicle driver scene task world action rule large small full semi auto inter
intra sub super hyper ultra micro macro meta well first second third fourth 3D 4D 2D""".split()
)
# Acronyms in the form in which they are written.
ACRONYMS = {
    x.lower(): x
    for x in """3D 4D 2D 3DGS 4DGS AV AVs CAV CAVs ADAS ADS BAM ECU HIL SIL radar FMCW GAN KPI mAP NeRF ROS CARLA NAVSIM FOV LED CPU GPU RCS FFT FFTs CPI
MIMO NCI RDM RDMs CFAR DBSCAN PN RF PI IM3 NF RM MAPE FMI OSI FMU UGV DVS FVD PSNR NVS SOTIF DCAS""".split()
}
# Forms of publication numbers and sheet numbers that run along the pages of patents.
RUNNING_NUMBERS = phrases("US {4}/{n} A{kind}; US {1,2},{3},{3} B{kind}; EP {1} {3} {3} A{kind}; EP {1} {3} {3} B{kind}; WO {4}/{n}; ‘WO {4}/{n}; 'WO {4}/{n}; WO {4}/{n} A{kind}; PCT/{cap}{cap}{4}/{n}; Sheet {n} of {n}")
# Lines at which the English specification or the claims of a patent end.
SPECIFICATION_ENDS = phrases("Patentansprüche; Patentanspruche; Revendications; References Cited; International Search Report; Classification Of Subject Matter; Figure 1")
# Headings with which a specification starts.
SPECIFICATION_STARTS = phrases("""claims; cross reference; cross-reference; related application; technical field; field of the invention; background; summary; brief summary;
description of embodiments; description of the preferred; detailed description; brief description of the; description""")
# Running lines of journals.
JOURNAL_LINES = phrases("""Volume {n}, 20{2}; IEEE Open Journal{any}; Authorized licensed use limited to:{any}; {4}-{4}/{2}/$31.00 © 20{2} IEEE; {4}-{4}/{2}/$31.00 ©20{2} IEEE;
Doi 10.{4,9}/{any}; Issn: {4}-{n}; Issn: {4}-{3}X; Sensors 20{2}, {n}, {n}; Vehicles 20{2}, {n}, {n}; {1,2} of {1,2}; Downloaded from http{any}; © 20{2} The Authors.{any}""")


def title_of(line: str) -> str | None:
    """The title of a ``# `` line, else None."""
    s = line.strip()
    return s[2:].strip() if s.startswith("# ") else None


def reads_as(text: str, starts: re.Pattern, *inside: re.Pattern) -> bool:
    """Whether a line starts with one of some forms, or has one of others inside, as whole words."""
    return bool(re.match(rf"{starts.pattern}\b", text, re.I)) or any(re.search(rf"\b{p.pattern}\b", text, re.I) for p in inside)
