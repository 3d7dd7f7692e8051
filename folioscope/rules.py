"""The caption rules: fixed values, whose order is the index of a rule in a feature vector."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    pattern: str
    label: str
    confidence: float


#: Pattern (found anywhere in a caption), label, confidence. Fixed values.
CAPTION_RULES = tuple(Rule(*row) for row in [
    (r"\bX[- ]?ray", "XR", 0.8),
    (r"\b(DXA|DEXA|BMD)\b", "XR", 0.8),
    (r"(?i)\b(radiograph)", "XR", 0.8),
    (r"(?i)\b(micro-?)?(a(ng|rter)iogra\w+)", "XR", 0.8),
    (r"\b(US)[ -]?imag\w*\b", "US", 0.8),
    (r"(?i)\b(ultra.?sonic|ultra.?sound)s?\b", "US", 0.9),
    (r"(?i)\b(sonogram)s?\b", "US", 0.9),
    (r"(?i)\b(brightness scan|echocardiograph\w*)s?\b", "US", 0.9),
    (r"\b([fN]?MR[IT])s?\b", "MR", 0.9),
    (r"(?i)\b((Magnetic resonance|MR) imag\w+)s?\b", "MR", 0.7),
    (r"\b(T[12].?weight\w*)\b", "MR", 0.8),
    (r"\b(CT)s?\b", "CT", 0.8),
    (r"\b(?i)(comput\w+.?tomograph\w+)\b", "CT", 0.9),
    (r"(?i)\b(endoscop\w*)\b", "EN", 0.9),
    (r"(?i)\b(photo(?!-)|photograph\w*)s?\b", "PX", 0.9),
    (r"(?i)\b(picture)s?\b", "PX", 0.6),
    (r"(?i)operat", "PX", 0.3),
    (r"\b(were taken)\b", "PX", 0.7),
    (r"(?i)\b(courtesy)\b", "PX", 0.3),
    (r"(?i)\b(((ao)?slo|MPE|TPEF|SHG|MPLSM)[ -]?imag\w+)\b", "UnspecifiedPhotograph", 0.9),
    (r"(?i)\b(diffus\w+ illuminat\w+)\b", "UnspecifiedPhotograph", 0.9),
    (r"(?i)\b(immuno-?staining)\b", "HX", 0.9),
    (r"(?i)\b(histolog[yi]\w*|immuno\W*histo\W*chemic\w*|histopatholog\w*)\b", "HX", 0.9),
    (r"(?i)\b((?:tumor|spindle) cell)s?\b", "HX", 0.7),
    (r"(?i)\b(ophtalmo\w+)\b", "RN", 0.9),
    (r"(?i)\b(optic disc|fundus|retinopathy)\b", "RN", 1),
    (r"(?i)\b(h[yi]per\W*pigment\w+)\b", "DM", 1),
    (r"(?i)\b(skin|rash|lesion|scar)\b", "DM", 0.7),
    (r"(?i)\b(magnification)\b", "UnspecifiedMicroscopy", 0.6),
    (r"(?i)\b(\w*oscop(y|ic))\b", "UnspecifiedMicroscopy", 0.4),
    (r"(?i)\b(microscop\w*)\b", "UnspecifiedMicroscopy", 0.9),
    (r"(?i)\b(error bars?)\b", "GX", 0.8),
    (r"(?i)\b([xyz].?axis|logarithmic)\b", "GX", 0.8),
    (r"(?i)\b(standard deviation|mean|p.?value)s?\b", "GX", 0.6),
    (r"(?i)\b(visualization|diagram|phylogram|dendogram)s?\b", "GX", 1),
    (r"(?i)\b(graphic\w+ represent\w+)\b", "GX", 1),
    (r"(?i)\b(plot(ted)?|alignment|tree)s?\b", "GX", 0.4),
    (r"(?i)\b(distribution|frequenc\w+|algorithm)s?\b", "GX", 0.6),
    (r"(?i)\b(schema(tic)?)\b", "DR", 0.8),
    (r"(?i)\b(map|network|topolog\w*)\b", "DR", 0.7),
    (r"(?i)\b(cartoon|((state|flow).?)?(?:chart|diagram))s?\b", "DR", 1),
    (r"(?i)\b(illustrat\w+)\b", "DR", 0.5),
    (r"(?i)\b(screen.?shot)\b", "UnspecifiedGraphic", 1),
    (r"(?i)\b(hyper.?link)\b", "UnspecifiedGraphic", 1),
    (r"(?i)\b(user|application|interface)\b", "UnspecifiedGraphic", 0.6),
    (r"(?i)\b((immuno)?blot|lane)s?\b", "GL", 1),
    (r"\b3D\b", "3D", 1.1),
    (r"(?i)\b(spatial|three\W+dimension\w*|Structur\w+\W+(?:alignment|motif)|space filling|side[ -]?chain|\w*(?:helix|helical)\w*)s?\b", "3D", 0.9),
    (r"(?i)\b(structur\w+)\b", "3D", 0.7),
    (r"(?i)\bImmuno-?localisation\b", "HX", 1),
    (r"(?i)\bsheets?\b", "HX", 0.6),
    (r"(?i)\b(gel)\b", "GL", 1),
    (r"\bPCR\b", "GL", 1),
    (r"(?i)\b(expression)\b", "GL", 0.7),
    (r"(?i)\b(?:graft\w*)\b", "GR", 0.8),
    (r"(?i)\b(angiogra\w*|dilatation)\b", "AN", 0.9),
    (r"(?i)\b(arter\w*)\b", "AN", 0.7),
    (r"(?i)\b(electron[ -]?micro\w*|dark field)\b", "EM", 1),
    (r"(?i)\b(scanning)\b", "EM", 0.9),
    (r"\b(S?EM)\b", "EM", 0.95),
    (r"(?i)fluorescen", "FL", 1),
    (r"(?i)\b(colonoscop\w*)\b", "EN", 0.9),
    (r"(?i)\bmass\b", "GR", 0.67),
    (r"(?i)\blateral\b", "PX", 0.7),
    (r"(?i)\bobtained\b", "GX", 0.71),
    (r"(?i)\barrow\b", "US", 0.62),
    (r"(?i)\bnumber\b", "GX", 0.89),
    (r"(?i)\bMean\b", "GX", 1),
    (r"(?i)\beffect\b", "GX", 0.83),
    (r"(?i)\bdistribution\b", "GX", 0.86),
    (r"(?i)\bcourse\b", "GX", 0.83),
    (r"<", "GX", 0.92),
    (r"(?i)\brespectively\b", "GX", 0.79),
    (r"(?i)\bmean\b", "GX", 1),
    (r"(?i)\bline\b", "GX", 0.91),
    (r"(?i)\bcyst\b", "GR", 0.75),
    (r"(?i)\bbladder\b", "XR", 0.62),
    (r"(?i)\banalysis\b", "GX", 0.62),
    (r"(?i)\bremoved\b", "GR", 0.67),
    (r"(?i)\bimage\b", "GX", 0.58),
    (r"(?i)\bvein\b", "GR", 0.71),
    (r"(?i)\bfemur\b", "XR", 0.71),
    (r"(?i)\bstain\b", "HX", 0.88),
    (r"(?i)\bbiopsy\b", "HX", 0.71),
    (r"(?i)\bimages\b", "CM", 0.6),
    (r"(?i)\bfocal\b", "HX", 0.67),
    (r"(?i)\bcytoplasm\b", "HX", 1),
    (r"(?i)\bimmunostaining\b", "HX", 0.75),
    (r"(?i)\bScale\b", "HX", 0.73),
    (r"(?i)\bmagnification\b", "HX", 0.91),
    (r"(?i)\blung\b", "CT", 0.62),
    (r"(?i)\bstaining\b", "HX", 0.89),
    (r"(?i)\bsize\b", "PX", 0.58),
    (r"(?i)\bcm\b", "PX", 0.67),
    (r"(?i)\bedges\b", "DR", 0.71),
    (r"(?i)\bfracture\b", "XR", 0.83),
    (r"\bGFP\b", "FL", 0.83),
    (r"\bDNA\b", "GL", 0.6),
    (r"(?i)\bWestern\b", "GL", 0.71),
    (r"(?i)\binteraction\b", "DR", 0.71),
    (r"(?i)\bRT\b", "GL", 0.71),
    (r"(?i)\bpathway\b", "DR", 0.88),
    (r"(?i)\bray\b", "XR", 0.81),
    (r"(?i)\bPlain\b", "XR", 1),
    (r"(?i)\bfluorescent\b", "FL", 1),
    (r"(?i)\bDAPI\b", "FL", 0.89),
    (r"(?i)\bdisc\b", "RN", 0.71),
    (r"(?i)\bLV\b", "US", 0.88),
    (r"(?i)\bartery\b", "AN", 0.69),
    (r"(?i)\bconfocal\b", "FL", 1),
    (r"(?i)\bultrasound\b", "US", 1),
    (r"(?i)\bradiograph\b", "XR", 1),
    (r"(?i)\bScanning\b", "EM", 0.86),
    (r"(?i)\bbp\b", "GL", 1),
    (r"(?i)\btomography\b", "CT", 1),
    (r"(?i)\bCT\b", "CT", 0.92),
    (r"(?i)\bMRI\b", "MR", 0.86),
    (r"(?i)\bEndoscopic\b", "EN", 0.86),
])

#: A pack for the documents of the test tables: a text's language by its function words, and some surface forms.
LANGUAGE_RULES = tuple(Rule(*row) for row in [
    (r"(?i)\bthe\b", "en", 0.8),
    (r"(?i)\band\b", "en", 0.6),
    (r"(?i)\bwith\b", "en", 0.7),
    (r"(?i)\bund\b", "de", 0.9),
    (r"(?i)\bder\b", "de", 0.7),
    (r"(?i)\bnicht\b", "de", 0.8),
    (r"(?i)\bles\b", "fr", 0.9),
    (r"(?i)\bdes\b", "fr", 0.5),
    (r"(?i)\bavec\b", "fr", 0.9),
    (r"(?i)\blos\b", "es", 0.9),
    (r"(?i)\bpara\b", "es", 0.7),
    (r"(?i)\bdel\b", "es", 0.6),
])
