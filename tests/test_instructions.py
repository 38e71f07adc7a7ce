"""Hand-worked instructions, one for each rule and repair."""

from kinetide.operators import instructions as I

VOCABULARY = [
    ("a", 0, "pick", "Pick up the cup."), ("a", 1, "pick", "Word"), ("b", 0, "pick", "pick up the cup"), ("b", 1, "grab", "Pick up the cup."), ("b", 2, "turn", "Turn on the sink faucet."), ("b", 3, "place", "Place the kettle on the stove burner."),
    ("b", 4, "nav", "Navigate to the counter."), ("b", 5, "nav", "Navigate to the stool."), ("b", 6, "open", "Open the drawer."), ("b", 7, "wash", "Move the spout to wash all locations of the sink basin."), ("b", 8, "place", "Place the cup."), ("b", 9, "fill", "Fill the kettle."),
]
CASES = [
    ("pick up THE cup (1/ 3)", None, None, "Pick up the cup.", "grab,pick"),
    ("Pick a cup", None, None, "Pick up the cup.", "grab,pick"),
    ("Pick up the mug from the rack and put it onto a tray", None, None, "Pick the mug from the rack and place it on the tray.", ""),
    ("pick the mug out of either bin", None, None, "Pick up the mug from the bin.", ""),
    ("set the mug into the bin", None, None, "Place the mug in the bin.", ""),
    ("put mug under the tap", None, None, "Place the mug under the tap.", ""),
    ("Walk back to the island", None, None, "Navigate to the island.", ""),
    ("go to the stool and pick it", None, None, "Pick up the it.", ""),
    ("slide the oven rack out and in", None, None, "Fully slide the oven rack in.", ""),
    ("slide top dishwasher rack out", None, None, "Fully slide the top dishwasher rack out.", ""),
    ("turn off the burner, back left", None, None, "Turn off the rear left burner of the stove.", ""),
    ("turn on the right front burner", None, None, "Turn on the front right burner of the stove.", ""),
    ("press center stove knob", None, None, "Turn on the center burner of the stove.", ""),
    ("turn the stove knob", None, None, "Turn the stove knob.", ""),
    ("press stop on microwave", None, None, "Press the stop button on the microwave.", ""),
    ("close the microwave", None, None, "Press the stop button on the microwave.", ""),
    ("open the microwave", None, None, "Press the start button on the microwave.", ""),
    ("turn the faucet", None, None, "Turn on the sink faucet.", "turn"),
    ("stop water in sink", None, None, "Turn off the sink faucet.", ""),
    ("decrease toaster oven dial", None, None, "Decrease the toaster oven temperature.", ""),
    ("push toaster", None, None, "Push down the lever of the toaster to turn it on.", ""),
    ("preheat oven", None, None, "Preheat the oven by turning the temperature knob.", ""),
    ("open the refrigerator doors", None, None, "Open the fridge doors.", ""),
    ("pull out the fridge drawer", None, None, "Fully open the fridge drawer.", ""),
    ("open the cabinet", "close", None, "Close the cabinet door.", ""),
    ("shut stand mixer", None, None, "Close the stand mixer head.", ""),
    ("Open the left drawer", None, None, "Open the drawer.", "open"),
    ("Open the left drawer", None, "use the LEFT one", "Open the left drawer.", ""),
    ("Pick up the cup of the set", None, None, "Pick up the cup.", "grab,pick"),
    ("fill the electric kettle", None, None, "Fill the kettle.", "fill"),
    ("Navigate to the stool at the counter", None, None, "Navigate to the stool.", "nav"),
    ("Navigate to the sofa on the dining counter", None, None, "Navigate to the counter.", "nav"),
    ("fill kettle", None, None, "Fill the kettle.", "fill"),
    ("put kettle on the front left burner of the stove", None, None, "Place the kettle on the stove burner.", "place"),
    ("open the sink", None, None, "Turn on the sink faucet.", "turn"),
    ("rinse sink basin", None, None, "Move the spout to wash all locations of the sink basin.", "wash"),
    ("place the cup at nearby counter", None, None, "Place the cup.", "place"),
    ("Wait and pick up the mug", None, None, "Wait and pick up the mug", ""),
    ("stack plates!", None, None, "Stack plates.", ""),
    ("  Hello there\n", None, None, "Hello there", ""),
    (None, None, None, "", ""), ("", "close", "x", "", ""), ("(1/2)", None, None, "(1/2)", ""), ("word", None, None, "word", ""),
]


def test_cases(spark):
    words = I.vocabulary(spark.createDataFrame(VOCABULARY, "file string, place int, skill string, text string"))
    rows = [(k, *c[:3], "clash") for k, c in enumerate(CASES)] * 2
    docs = spark.createDataFrame(rows, "id int, prompt string, hint string, goal string, text string").repartition(3)
    got = sorted((r["id"], r["instruction"], ",".join(r["skills"])) for r in I.canonical(docs, words, "prompt", "hint", "goal").collect())
    assert got == sorted([(k, *c[3:]) for k, c in enumerate(CASES)] * 2)
    assert I.canonical(docs.limit(0), words, "prompt").collect() == []
    none = I.vocabulary(spark.createDataFrame([], "file string, place int, skill string, text string"))
    assert {r["instruction"] for r in I.canonical(docs.where("id = 0"), none, "prompt").collect()} == {"Pick up the cup."}
