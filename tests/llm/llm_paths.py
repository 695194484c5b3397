"""Tables of these tests, and column names that the operators must bear."""

SF001 = "/root/testdata/sf0.01"

#: Columns of the tables, and extra ones named like results and helpers.
CLASH = ("rid", "n_words", "kept", "fp", "spans", "base", "cands", "size", "target", "cum", "blob", "findings", "lang_pred",
         "score", "p", "c", "text_hash", "root", "component_id", "host", "path", "rule", "label", "payload", "sha1", "v", "h",
         "id", "tree", "pos", "n", "mid", "range", "digest", "part", "proof", "ids", "i", "last", "at", "piece", "draws", "output", "form",
         "epoch", "finish", "copies")
