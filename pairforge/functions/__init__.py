from pairforge.functions.predicates import *  # noqa: F403
from pairforge.functions.regions import *  # noqa: F403
from pairforge.functions.text import *  # noqa: F403
