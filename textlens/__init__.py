"""textlens: evaluate generated text at table scale on Spark.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function:

* ``textlens.functions``  column expressions (tokenizers, response parsing, metric expressions)
* ``textlens.operators``  relational operators (n-gram LM, threshold scoring, IDF, similarity)
* ``textlens.sources``    readers and writers (CSV prompts, JSON, result sinks)
* ``textlens.plans``      composed jobs (the experiment, fixtures derived from the driver tables)
* ``textlens.streaming``  the scoring job on a Structured Streaming source
"""

from textlens.session import get_session, checkpoint_dir  # noqa: F401
