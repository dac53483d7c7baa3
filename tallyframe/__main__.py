"""python -m tallyframe"""

import sys

from tallyframe.cli import main

sys.exit(main())
