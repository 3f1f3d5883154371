"""Tables of the dialogue model and its controlled vocabularies.

conversations(conv_id, source_id, corpus, corpus_ord, ordinal, title, meta: map<string, string>)
turns(conv_id, pos, text, speaker, action, annotation, native_label)
edges(conv_id, ord, source, target, type, provenance): the turn at `source` answers `target`
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Native label to action.
ACTIONS = {
    "QAP": "answer", "Clarification_question": "clarify", "Q-Elab": "elaborate", "Acknowledgement": "acknowledge",
    "Correction": "correct", "Comment": "comment", "Continuation": "continue", "Elaboration": "elaborate",
    "Explanation": "explain", "Result": "result", "Contrast": "contrast", "Background": "background",
    "Conditional": "condition", "Narration": "narrate", "Alternation": "alternative", "Parallel": "parallel",
    "Probing": "probe", "Non-probing-deliberation": "propose", "Non-deliberation": "social",
    "1": "inform", "2": "question", "3": "directive", "4": "commissive",
}
# Move groups, actions that are mere roles, trusted provenances, flag bits.
MOVES = ("question", "clarify", "answer", "comment", "elaborate", "acknowledge", "correct", "propose", "probe", "inform", "directive", "other", "unknown")
ROLE_ACTIONS = ("user", "assistant", "0", "unknown")
TRUSTED = ("human-discourse", "platform-reply", "human-link", "synthetic-example")
FLAGS = {"group": 1, "nonadjacent": 2, "clarification": 4, "branching": 8, "targets_available": 16}
FIELDS = (
    "log_turns", "speaker_fraction", "speaker_switching", "speaker_entropy", "largest_speaker_share", "known_action_fraction",
    "target_density", "nonadjacent_fraction", "mean_target_span", "max_target_span", "branching_targets",
    "clarification_fraction", "answer_fraction", "question_fraction", "acknowledgement_fraction", "proposal_fraction",
    "action_entropy", "mean_log_word_count", "lexical_recurrence",
)
WIDTH, STRIDE, MAX_WINDOWS, LEAST_TURNS = 12, 6, 64, 4
VERSION = "2"  # of these tables


@dataclass(frozen=True)
class Library:
    conversations: DataFrame
    turns: DataFrame
    edges: DataFrame

    def union(self, other: Library) -> Library:
        pairs = ((self.conversations, other.conversations), (self.turns, other.turns), (self.edges, other.edges))
        return Library(*(a.unionByName(b, allowMissingColumns=True) for a, b in pairs))
