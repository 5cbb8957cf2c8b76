"""Word lists that control and raising subtasks draw from, and mass nouns.

Fixed values, in natural order.
"""

SUBJECT_RAISING_VERBS = (
    "seem appear happen tend look prove remain continue begin start stop fail threaten promise cease come grow commence "
    "chance transpire hap bid_fair loom deserve"
).split()
OBJECT_RAISING_VERBS = (
    "want need like expect hate prefer mean wish imagine guess suppose reckon believe find feel know consider allow cause "
    "understand assume presume suspect claim maintain declare state report judge hold deem view perceive observe note reveal "
    "prove show require permit order command forbid authorize intend discover estimate calculate acknowledge admit affirm "
    "allege anticipate apprehend ascertain assert avow certify conceive conjecture deduce demonstrate determine discern enable "
    "envisage envision foresee grant guarantee hypothesize infer posit postulate predict proclaim pronounce recognize recollect "
    "remember stipulate surmise verify warrant"
).split()
RAISING_ADJECTIVES = (
    "likely unlikely sure certain supposed going bound apt liable set due prone fated destined doomed slated scheduled wont "
    "calculated rumored reputed alleged poised expected anticipated predicted estimated projected forecast reported believed "
    "thought assumed known understood claimed presumed suspected deemed said acknowledged recognized accepted conceded noted "
    "asserted inferred deduced established demonstrated posited postulated hypothesized proposed required needed mandated "
    "stipulated specified feared hoped"
).split()
CONTROL_ADJECTIVES = (
    "eager ready willing unable able happy sad afraid anxious excited careful lucky reluctant hesitant keen loath quick slow "
    "prepared determined motivated impatient intent disinclined indisposed solicitous studious importunate powerless impotent "
    "desperate resolved fain minded chary"
).split()
TOUGH_ADJECTIVES = (
    "easy hard fun nice good bad cool great safe boring weird tough simple scary sweet pleasant unpleasant lovely wonderful "
    "terrible horrible awful difficult dangerous impossible interesting exciting amazing relaxing stressful awkward strange "
    "tiring painful annoying tricky risky useful pointless delightful enjoyable fascinating engaging entertaining challenging "
    "complicated confusing frustrating exhausting draining demanding intimidating charming refreshing comforting soothing "
    "calming satisfying disappointing disturbing shocking embarrassing frightening tedious tiresome dreadful costly wasteful "
    "stimulating enlightening educational informative illuminating effortless breezy laborious arduous burdensome onerous "
    "strenuous exasperating infuriating maddening monotonous unbearable intolerable insufferable excruciating hazardous "
    "treacherous perilous formidable loathsome repulsive irksome wearisome cumbersome unsettling unnerving disarming "
    "invigorating uplifting edifying fruitless futile"
).split()
MASS_NOUNS = (
    "advice air art baggage bread butter cash cheese clothing coffee courage data equipment evidence fish flour food fun "
    "furniture gas gold grain grass hair happiness homework honey information knowledge labor luggage machinery meat milk money "
    "music news oil paper progress rain rice research salt sand software sugar tea traffic travel water weather wine wood work"
).split()

CONTROL_POOLS = {
    "verb:subject_raising": SUBJECT_RAISING_VERBS,
    "verb:object_raising": OBJECT_RAISING_VERBS,
    "adj:raising": RAISING_ADJECTIVES,
    "adj:control": CONTROL_ADJECTIVES,
    "adj:tough": TOUGH_ADJECTIVES,
}


def control_adjective_pools(subtask: str) -> tuple[str, str]:
    """The pools of the good and the bad side of a control or raising subtask."""
    return {
        "tough_vs_raising_1": ("adj:tough", "adj:raising"),
        "tough_vs_raising_2": ("adj:raising", "adj:tough"),
        "expletive_it_object_raising": ("adj:tough", "adj:tough"),
    }.get(subtask.strip().lower(), ("adj:raising", "adj:control"))


def raising_verb_pool(subtask: str) -> str:
    return "verb:object_raising" if "object_raising" in subtask.lower() else "verb:subject_raising"
