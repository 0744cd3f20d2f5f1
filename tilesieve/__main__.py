import sys

from tilesieve.cli import main

sys.exit(main())
