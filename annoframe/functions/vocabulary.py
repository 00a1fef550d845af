"""Words, lists, numbers and formats that results depend on.

Nothing in this file is logic. Change a value here and labels, filters or
prompts change with it.
"""

from __future__ import annotations

# A transcript holding one of these markers is not speech.
NON_SPEECH_MARKERS = ("<SIL>", "<MUSIC>", "<NOISE>", "<OTHER>")

# Punctuation markers that are cut out of a transcript.
PUNCTUATION_MARKERS = ("<COMMA>", "<PERIOD>", "<QUESTIONMARK>", "<EXCLAMATIONPOINT>")

# The side attributes and the confidence a label must exceed.
ATTRIBUTES = ("age", "accent", "brightness", "emotion", "gender", "smoothness")
CONFIDENCE = 0.95
MISSING_LABEL = "None"
MISSING_VALUE = 0.0

# Columns the background side branch does not need.
BACKGROUND_UNUSED = (
    "speaker", "audio", "url", "category", "phonemes", "accent", "brightness", "smoothness", "emotion",
)
NOISY_LABELS = ("slightly noisy", "noisy", "very noisy")

# Label vocabularies, lowest bin first.
SPEAKING_RATE_LABELS = (
    "very slowly", "slowly", "slightly slowly", "moderate speed", "slightly fast", "fast", "very fast",
)
NOISE_LABELS = (
    "very noisy", "noisy", "slightly noisy", "balanced in clarity", "slightly clean", "clean", "very clean",
)
REVERBERATION_LABELS = (
    "very distant-sounding", "distant-sounding", "slightly distant-sounding",
    "slightly close-sounding", "very close-sounding",
)
MONOTONY_LABELS = (
    "very monotone", "monotone", "slightly expressive and animated",
    "expressive and animated", "very expressive and animated",
)
PITCH_LABELS = (
    "very low-pitch", "low-pitch", "slightly low-pitch", "moderate pitch",
    "slightly high-pitch", "high-pitch", "very high-pitch",
)
GENDERS = ("male", "female")

# How many standard deviations a value may lie from the mean to count when edges are fitted.
PITCH_TOLERANCE = 2.0
SPEAKING_RATE_TOLERANCE = 4.0
NOISE_TOLERANCE = 3.5
REVERBERATION_TOLERANCE = 4.0
MONOTONY_TOLERANCE = 4.0

# Names of the vocabularies in a text-bin JSON file.
VOCABULARY_KEYS = {
    "speaking_rate": "speaker_rate_bins",
    "noise": "snr_bins",
    "reverberation": "reverberation_bins",
    "speech_monotony": "utterance_level_std",
    "pitch": "speaker_level_pitch_bins",
}
PITCH_EDGE_KEY = "pitch_bins_{category}"

# Published edges that make labels comparable between corpora.
PUBLISHED_EDGES = {
    "speaking_rate": [
        0.0, 3.8258038258038254, 7.651607651607651, 11.477411477411476,
        15.303215303215302, 19.129019129019127, 22.95482295482295, 26.78062678062678,
    ],
    "noise": [
        17.12751579284668, 25.4012325831822, 33.67494937351772, 41.94866616385323,
        50.22238295418875, 58.49609974452427, 66.76981653485979, 75.04353332519531,
    ],
    "reverberation": [10, 35, 45, 55, 59, 60],
    "speech_monotony": [0.0, 20.37920924595424, 40.75841849190848, 70, 90, 142.6544647216797],
    "pitch_bins_male": [
        64.6531982421875, 81.66683959960938, 98.68048095703125, 115.69412231445312,
        132.707763671875, 149.72140502929688, 166.73504638671875, 183.74868774414062,
    ],
    "pitch_bins_female": [
        120.17855072021484, 141.6242690945264, 163.06998746883795, 184.51570584314953,
        205.96142421746106, 227.40714259177264, 248.8528609660842, 270.29857934039575,
    ],
    "si-sdr": [-17.804332733154297, -0.40644073486328125, 10, 20, 25, 28, 34.38934326171875],
    "pesq": [1, 1.7, 2.4, 3.1, 3.6, 4, 4.499948978424072],
}

# Signal constants.
VAD_FRAMES_PER_SECOND = 16000 / 270
PERIODICITY_THRESHOLD = 0.065
EMPTY_SPEECH_SECONDS = 0.01
QUALITY_SECONDS = 15

# Prompt layout. Keys stand in square brackets and are replaced by column values.
PROMPT_KEYS = (
    "gender", "age", "reverberation", "noise", "speech_monotony", "pitch", "speaking_rate", "background",
)
PROMPT_END = (
    "\nKeywords:\n"
    "'[gender]', '[age]', '[reverberation]', '[noise]', '[speech_monotony]', '[pitch]', "
    "'[speaking_rate]', '[background]'"
    "\nThe corresponding description is:\n\n"
)
PROMPT_EXAMPLES_HEADING = "Examples:\n"
EXAMPLES_PER_PROMPT = 3
VARIANTS = 5

SHARDS = 5

# Cells of a CSV label column that mean "no label".
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
